"""Learned operators: held-out accuracy, odd texts, missing labels."""

import itertools

import numpy as np
import odd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urbanpulse.llm import decontaminate, language, quality, toxicity
from urbanpulse.llm.text import Memory

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_languages_of_the_held_out_fold(spark, docs):
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark):
    own = odd.documents(spark)
    got = odd.by_id(language.identify(own))
    assert len(got) == len(odd.TEXTS) and language.identify(own).count() == own.count()
    for i, text in enumerate(odd.TEXTS):
        nothing = not any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == language.UNKNOWN) == nothing and (got[i].score == 0) == nothing
    assert language.identify(own.limit(0)).count() == 0
    unlabelled = own.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {language.UNKNOWN}


def longest_parse(text, word):
    count, at = 0, 0
    while at < len(word):
        size = max([k for k in range(1, len(word) - at + 1) if word[at:at + k] in text], default=1)
        count, at = count + 1, at + size
    return count


def test_phrases_are_longest_matches():
    text = " banana band cabana "
    parser = language.CrossParser([language.suffix_automaton(text)])
    words = ["banana", "nab", "cab", "zzz", "bandana", "x", "an", "canal", "b" * 9]
    assert parser(words)[:, 0].tolist() == [longest_parse(text, f" {w} ") for w in words]


def test_toxicity_of_the_held_out_fold(spark, docs, labels):
    found = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    mean = {t: np.mean([r.score for r in found if r.toxic == t]) for t in (0, 1)}
    assert mean[1] > 3 * mean[0]
    assert np.mean([r.predicted == r.toxic for r in found if r.held_out]) > 0.85


def test_toxicity_without_a_class(spark, docs, labels):
    own = odd.documents(spark)
    assert {r.score for r in toxicity.score(own, labels.limit(0)).collect()} == {0.5}
    nothing = spark.createDataFrame([(i, None, None) for i in range(20)], "doc_id long, quality int, toxic int")
    assert toxicity.score(own, nothing).count() == own.count()
    clean = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(own, clean).collect()} == {0.0}
    assert toxicity.score(own.limit(0), clean).count() == 0


def test_near_second_person_and_obfuscation():
    own = toxicity.PieceFeatures([("idiot", 40.0), ("scum", 20.0)])
    texts = ["you are an IDIOT !!", "1d10t", "scum one two three four five six seven you", "", "fine words"]
    pieces = [t.split() for t in texts]
    table = toxicity.features(own([p for ps in pieces for p in ps]), np.array([len(p) for p in pieces]))
    column = lambda n: table[:, toxicity.FEATURES.index(n)].tolist()
    assert column("hits") == [1, 1, 1, 0, 0] and column("kinds") == [1, 1, 1, 0, 0]
    assert column("near_second_person") == [1, 0, 0, 0, 0]
    assert [x > 0 for x in column("obfuscated")] == [False, True, False, False, False]
    assert [x > 0 for x in column("sure")] == [True, False, False, False, False]


def test_quality_against_labels(spark, docs, labels):
    found = quality.scored(docs).join(labels, "doc_id").collect()
    bad, good = ([r.accepted for r in found if r.quality == q] for q in (0, 1))
    assert np.mean(bad) < 0.1 and np.mean(good) > 0.97


def test_quality_of_odd_texts(spark):
    own = odd.documents(spark)
    got = odd.by_id(quality.scored(own))
    assert len(got) == len(odd.TEXTS) and got[0].score == got[1].score == got[2].score == 0
    kept = quality.accepted(own)
    assert kept.dtypes == own.dtypes and kept.count() <= own.count()
    assert quality.scored(own.limit(0)).count() == 0 and quality.accepted(own.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_good_labellers():
    rng = np.random.default_rng(5)
    n, labellers = 4_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    right = np.linspace(0.97, 0.6, labellers)
    votes = np.where(rng.random((n, labellers)) < right, np.where(good, quality.GOOD, quality.BAD)[:, None], np.where(good, quality.BAD, quality.GOOD)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns = (votes * 3 ** np.arange(labellers)).sum(axis=1)
    names, counts = np.unique(patterns, return_counts=True)
    chance = quality.posteriors(dict(zip(names.tolist(), counts.tolist())))
    assert np.mean([(chance[p] >= 0.5) == g for p, g in zip(patterns.tolist(), good)]) > 0.95


def test_contained_items(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[:40])
    texts = [
        item, f"before {item.upper()} after", " ".join(f"x{i}" for i in range(20_000)) + " " + item, " ".join(words[:30]), " ".join(words[:36]),
        " ".join(" ".join([*words[i:i + 5], "z"]) for i in range(36)), "say two words here", "say two other words", None, "", "!! -- ??",
        item.replace(" ", ", "),
    ]
    own = odd.documents(spark, texts)
    items = spark.createDataFrame(
        [(1, item, "x"), (2, "two words", "x"), (3, "", "x"), (4, None, "x"), (None, "say two", "x"), (2, "two words", "x")] +
        [(100 + i, " ".join(f"q{i}_{k}" for k in range(12)), "x") for i in range(20)], "item_id long, text string, doc_id string")
    want = []
    for text in texts:
        own_words = decontaminate.words_of(text or "")
        found = []
        for row in items.where("item_id IS NOT NULL").collect():
            ws = decontaminate.words_of(row.text or "")
            n = min(5, len(ws))
            grams = {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set()
            there = set(zip(*[own_words[k:] for k in range(n)])) if n else set()
            if grams and len(grams & there) >= 0.8 * len(grams):
                found.append(row.item_id)
        want.append(sorted(found))
    assert [bool(w) for w in want[:6]] == [True, True, True, False, True, True]
    for block in (1_000, 6):
        got = odd.by_id(decontaminate.contained_items(own, items, block))
        assert [got[i].item_ids for i in range(len(texts))] == want
        assert [r.contaminated for _, r in sorted(got.items())] == [bool(w) for w in want]
    clean = decontaminate.without_items(own, items)
    assert clean.dtypes == own.dtypes and {r.doc_id for r in clean.collect()} == {None, *[i for i, w in enumerate(want) if not w]}
    assert decontaminate.contained_items(own.limit(0), items).count() == 0
    assert not any(itertools.chain.from_iterable(r.item_ids for r in decontaminate.contained_items(own, items.limit(0)).collect()))


def test_sampled_shares_travel_without_zeros():
    texts = ["Some plain words, said twice: some plain words!!", "the the the 12 12 A-b", "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    dense = quality.Pieces(Memory(quality.describe), [t or "" for t in texts]).shares()
    (sent,) = quality.vote_batches([batch], True)
    again = np.zeros_like(dense)
    for row, bins, shares in zip(again, sent.column("bins").to_pylist(), sent.column("shares").to_pylist()):
        row[np.frombuffer(bins, np.uint16)] = np.frombuffer(shares, np.float32)
    assert dense.any() and np.array_equal(again, dense)
    assert sent.nbytes < 0.05 * dense.nbytes
