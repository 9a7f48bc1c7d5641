"""Documents that operators must not stumble over, with columns whose names they use inside."""

from __future__ import annotations

TEXTS = [
    None, "", " \n\t ", "a", "one two", "ONE two", "don't DON'T x's  !'s", "<|endoftext|> a <|endoftext|><|startoftext|>b",
    "a\x1cb \x1c c", "é 　x \xa0 y", "1234 56 ⅷ², ...", "x" * 60_000, "日本語テキスト 한국어 🎉🎉 é ΣΑΣ İ",
    " lead", "trail ", "a\r\n b", "tie tie tie tie tie tie tie", "the same words of the same text " * 30, "the same words of the same text " * 30,
    "word " * 20_000, "-- !! ##", "a" * 49, "a" * 50, "a" * 51,
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, class string, `_found` string, component long, part int"


def documents(spark, texts=TEXTS):
    """The texts, the last row twice, and two rows without doc_id."""
    rows = [(i, t, ("en", "de", None)[i % 3], None, None, 0.5, "c", "f", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no number one two three four five", "en", *[None] * 7), (None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, COLUMNS)


def by_id(frame) -> dict:
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}
