"""Diagonal voting for license phrases and notices against plain Python."""

import re

from odd import TEXTS, documents
from urbanpulse.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
LINES = [
    "Released under the MIT License.", "MIT license mit LICENSE; mit-license/MIT\nlicense", "the apache  license", "general public license general public",
    "General, public. License!", "mit licenses", "mit é license", "x mit license apache license general public license",
    NOTICE, NOTICE.replace("binary", "any binary"), NOTICE.replace(" or without", ""), NOTICE[:40],
    f"{NOTICE}. Then other words stand here. {NOTICE}", "mit license " * 3_000, "Licensed under CC BY-NC 4.0", "MİT LİCENSE",
]


def plain(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_every_base_place_is_found(spark):
    texts = TEXTS + LINES
    rows = licenses.scan(documents(spark, texts)).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
            assert r["n_base"] == 0 or r["score"] == 1


def test_notices_with_words_put_in_or_left_out(spark):
    found = {r["doc_id"]: r for r in licenses.scan(documents(spark, LINES)).collect() if r["doc_id"] is not None}
    whole, more, less, piece, twice = (found[i] for i in range(8, 13))
    assert whole["labels"] == more["labels"] == less["labels"] == twice["labels"] == "bsd" and piece["labels"] == ""
    assert whole["score"] == 1 > more["score"] >= licenses.COVER <= less["score"] < 1
    assert found[14]["labels"] == "cc-by-nc"


def test_spans_name_their_words(spark):
    spans = licenses.license_spans(documents(spark, [f"a b {NOTICE} c d", f"{NOTICE} {NOTICE}"]).where("doc_id IS NOT NULL").distinct())
    n = len(WORD.findall(NOTICE.lower()))
    assert sorted((r["doc_id"], r["first_word"], r["last_word"]) for r in spans.collect()) == [(0, 2, n + 1), (1, 0, n - 1), (1, n, 2 * n - 1)]


def test_empty_table(spark):
    assert licenses.scan(documents(spark).limit(0)).collect() == []
