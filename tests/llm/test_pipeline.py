"""The pipeline stage by stage against plain Python, and every numbered query on empty tables."""

import hashlib
import itertools

import corpus_pipeline
import numpy as np
import odd
import oracle
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from urbanpulse.llm import decontaminate, jaccard
from urbanpulse.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = tables[name] = spark.read.parquet(str(tmp_path / name))
    assert all(tables[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    rows = {n: {r.doc_id: r for r in t.collect()} for n, t in tables.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert np.mean([i in rows["quality"] for i, q in labels.items() if q == 1]) > 0.97
    assert np.mean([i in rows["quality"] for i, q in labels.items() if q == 0]) < 0.1

    rule = jaccard.Rule(5, 80)
    sets = {i: jaccard.word_set(r.text.encode(), 5) for i, r in rows["quality"].items()}
    least = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if rule.linked(sets[a], sets[b])]
    for _ in range(len(links)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a, b in links):
            break
    assert set(rows["near_duplicates"]) == {i for i in sets if least[i] == i}

    items = [set(zip(*[w[k:] for k in range(5)])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if len(w := decontaminate.words_of(r.text)) >= 5]
    def leaks(text):
        w = decontaminate.words_of(text)
        own = set(zip(*[w[k:] for k in range(5)]))
        return any(len(own & i) >= 0.8 * len(i) for i in items)
    assert set(rows["decontamination"]) == {i for i, r in rows["near_duplicates"].items() if not leaks(r.text)}

    assert set(rows["surrogates"]) == set(rows["decontamination"])
    changed = [i for i, r in rows["surrogates"].items() if r.text != rows["decontamination"][i].text]
    assert changed and not any("example.com" in rows["surrogates"][i].text for i in changed)
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    for i, row in rows["surrogates"].items():
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert rows["tokens"][i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert set(rows["tokens"]) == set(rows["surrogates"])
    again = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert again == {i: r.ids_sha256 for i, r in rows["tokens"].items()}


def test_stages_with_odd_rows(spark):
    docs = odd.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, FOLDER)
            assert out.count() <= rows.count()
            assert name == "tokens" or out.dtypes == docs.dtypes


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in TABLES:
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name, monkeypatch):
    monkeypatch.setattr(oracle.catalog, "queries", lambda: QUERIES)
    monkeypatch.setattr(oracle.catalog, "oracle_sql", lambda: ORACLES)
    assert oracle.compare(spark, name, FOLDER) is None

