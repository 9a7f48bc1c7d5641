"""Token ids and counts against the tokenizers library."""

import hashlib

import numpy as np
import odd
import pandas as pd
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from urbanpulse.llm import bpe, lexicon, token_counts, tokens

DOCS = "/root/testdata/sf0.001/documents.parquet"


def all_documents(spark):
    own = spark.read.parquet(DOCS).selectExpr("doc_id + 1000 AS doc_id", "text")
    return odd.documents(spark).select("doc_id", "text").union(own)


@pytest.mark.parametrize("words", [0, 50, 65_536])
def test_ids_and_decoded_text_equal_the_library(spark, words):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    docs = all_documents(spark)
    got = odd.by_id(tokens.digests(tokens.round_trip(docs, words=words)))
    rows = [r for r in docs.collect() if r.doc_id is not None]
    for row, code in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        mine = got[row.doc_id]
        assert mine.n_tokens == len(code.ids)
        assert mine.ids_sha256 == hashlib.sha256(np.array(code.ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(code.ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_character_alone_and_after_a_letter(spark):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    characters = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [c for ch in characters for c in (ch, f"a{ch}", f"{ch}1'S{ch}")]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = {r["doc_id"]: bytes(r["ids"]) for r in tokens.encode(docs, tokens.build_lexicon(docs)).toLocalIterator()}
    want = [np.array(c.ids, "<u4").tobytes() for c in library.encode_batch(texts, add_special_tokens=False)]
    assert [hex(ord(texts[i][-1])) for i, ids in enumerate(want) if got[i] != ids] == []


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    docs = all_documents(spark)
    got = odd.by_id(token_counts.token_counts(docs))
    rows = [r for r in docs.collect() if r.doc_id is not None]
    for row, code in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        mine = got[row.doc_id]
        assert (mine.n_bytes, mine.n_tokens, mine.over_limit) == (len((row.text or "").encode()), len(code.ids), len(code.ids) > 1024)


def test_every_row_is_returned(spark):
    docs = odd.documents(spark)
    assert token_counts.token_counts(docs).count() == docs.count() == tokens.round_trip(docs, words=5).count()
    none = docs.limit(0)
    assert token_counts.token_counts(none).count() == 0 and tokens.round_trip(none).count() == 0


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    words = ["a", "an", "and", "band", "hand", "stand", "é", "🎉", "standing", "banding"]
    lengths = np.arange(1, len(words) + 1)
    file = tmp_path / "lexicon"
    file.write_bytes(lexicon.compile_lexicon(words, np.arange(lengths.sum()), lengths))
    table = lexicon.Lexicon(str(file))
    order = sorted(words, key=str.encode)
    assert [order[p] for p in table.find(words)] == words
    assert (table.find(["", "b", "ban", "standin", "standings", "q", "\U0001f60b", "zebra"]) == -1).all()
    assert len(table.base) < 1 + len({w[:k] for w in words for k in range(1, len(w.encode()) + 1)})  # endings are shared
    place = table.find(["and"])[0]
    start = int(lengths[:2].sum())
    assert table.ids[table.start[place]:table.start[place + 1]].tolist() == list(range(start, start + 3))


def test_empty_lexicon(tmp_path):
    (tmp_path / "none").write_bytes(lexicon.compile_lexicon([], np.zeros(0), np.zeros(0, int)))
    assert lexicon.Lexicon(str(tmp_path / "none")).find(["a", ""]).tolist() == [-1, -1]


def test_merges_of_runs_do_not_overlap():
    table = bpe.PairTable(np.array([1, 2]), np.array([1, 2]), np.array([2, 3]))
    left, lengths = bpe.merge(table, np.array([1] * 5 + [1] * 4 + [7]), np.array([5, 4, 1]))
    assert left.tolist() == [3, 1, 3, 7] and lengths.tolist() == [2, 1, 1]
