"""Importance resampling against plain Python, and the selection of a cutoff."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from odd import TEXTS, documents
from urbanpulse.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PROSE = [" ".join(f"w{(i * j) % 37}é" for j in range(15 + i % 20)) for i in range(60)]


def features(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target, percent=25):
    """docs: (doc_id, text) with different ids."""
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[0]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out, fit = {}, []
    for doc_id, text in docs:
        own, n_words = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in map(bucket, own))
        weight = total // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[doc_id] = [len(own), weight, score, None]
        if n_words >= 20:
            fit.append((-score, doc_id))
    for rank, (_, doc_id) in enumerate(sorted(fit)[:len(fit) * percent // 100], 1):
        out[doc_id][3] = rank
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("few", (20_000, 3))
def test_equals_plain_python(spark, monkeypatch, few):
    monkeypatch.setattr(resample, "FEW", few)
    texts = TEXTS + PROSE
    docs = documents(spark, texts).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    target = spark.createDataFrame([(1, "w1é w2é w3é one two"), (2, None), (3, "tie tie")], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in resample.resample(docs, target).collect()}
    assert got == plain(list(enumerate(texts)), ["w1é w2é w3é one two", None, "tie tie"])


def test_long_words_and_every_pair(spark):
    texts = ["x" * n + " " + "y" * m for n in (1, 63, 64, 65, 300) for m in (1, 62, 63, 64, 65, 66, 200)]
    found = resample.Features()(texts)[0].reshape(-1, 3).tolist()
    assert found == [[bucket(f) for f in features(t)[0]] for t in texts]


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(None if i % 9 == 0 else 5, "one two three four five " * 6) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.limit(0)
    out = resample.resample(docs, target).collect()
    assert len(out) == 40 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 11))
    best = sorted(out, key=lambda r: r["rank"] or 99)
    assert [r["score"] for r in best[:10]] == sorted((r["score"] for r in out), reverse=True)[:10]


@pytest.mark.parametrize("wanted", (1, 2, 700, 2_999, 3_000))
def test_cutoff_of_skewed_keys(spark, monkeypatch, wanted):
    monkeypatch.setattr(resample, "FEW", 10)
    monkeypatch.setattr(resample, "CHUNK", 64)
    rows = [(7 if i % 3 == 0 else i * i % 101, i % 50, 1, i) for i in range(3_000)]
    table = spark.createDataFrame(rows, "score long, doc_id long, n_features long, place long").repartition(5)
    score, doc_id, n, place = sorted(rows, key=lambda r: (-r[0], r[1:]))[wanted - 1]
    assert resample.cutoff(table, wanted) == (-score, 0, doc_id, n, place)


def test_empty_tables(spark):
    none = documents(spark).limit(0)
    assert resample.resample(none, none).collect() == []
    drawn = resample.drawn_documents(documents(spark), none, percent=100)
    assert drawn.columns == documents(spark).columns and {len((r["text"] or "").split()) >= 20 for r in drawn.collect()} == {True}
