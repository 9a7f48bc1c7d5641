"""Token counts by rank-synchronous array merging (operator 9).

The pre-tokens of a batch are ragged numpy arrays; in each round every sequence merges its own
lowest-ranked pair, all sequences at once, and the symbols that survive are counted. Nothing
is shuffled: each document is counted in the task that reads it.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; other columns
of the input are ignored, so their names cannot clash; an empty table gives an empty result.
A special token's string inside a text counts as that one token. Vocabularies with white space
kept and no normaliser are meant (byte level).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.bpe import vocabulary
from urbanpulse.llm.text import SPACES, Memory, ragged_sum, text_slices

# The pattern of byte-level vocabularies; a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A blank between two visible characters begins a pre-token whatever stands around it.
CUT = re.compile(r"(?<=\S) (?=\S)")

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


PATTERN = regex.compile(WORDS.replace(r"^\s", f"^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))


def cut(text: str) -> list[str]:
    """Pieces that never share a pre-token; all but the first begin with their blank."""
    if not text:
        return []
    plain = "  " not in text and " \n" not in text and "\n " not in text and " " not in text[:1] + text[-1:]
    pieces = text.split(" ") if plain and text.replace("\n", "").isprintable() else CUT.split(text)
    return [pieces[0], *[" " + p for p in pieces[1:]]]


def pre_tokens(piece: str) -> list[str]:
    """The words of a piece; one that is all letters after its blank is one word."""
    return [piece] if piece[piece[0] == " ":].isalpha() else PATTERN.findall(piece)


class Counter:
    """Tokens of distinct pieces; pre-tokens that pieces share are merged once."""

    def __init__(self, path: str):
        self.words = Memory(lambda words: vocabulary(path).encode_words(words)[1])

    def __call__(self, pieces: list[str]) -> np.ndarray:
        words = [pre_tokens(p) for p in pieces]
        return ragged_sum(self.words([w for ws in words for w in ws]), np.fromiter(map(len, words), np.int64, len(words)))


def count_batches(batches, path: str):
    specials = vocabulary(path).specials
    special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    memory = Memory(Counter(path))
    for part, texts in text_slices(batches):
        pieces, lengths, extra = [], [], []
        for text in texts:
            parts = special.split(text) if special and "<" in text and special.search(text) else [text]
            own = [p for t in parts for p in cut(t)]
            pieces += own
            lengths.append(len(own))
            extra.append(len(parts) - 1)
        counts = ragged_sum(memory(pieces), np.array(lengths)) + np.array(extra)
        sizes = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than `limit`) of every document."""
    file = path or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = rows.mapInArrow(lambda batches: count_batches(batches, file), SCHEMA)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
