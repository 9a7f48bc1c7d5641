"""Importance resampling towards a target: draw the documents whose word and word-pair features are likelier in a target.

Features fall into BUCKETS by CRC-32. Counts of all documents and of all target texts give each bucket a gain; a document's
weight is the floored mean of its features' gains, its score adds Gumbel noise drawn from its doc_id, and the best share
of the documents with MIN_WORDS words or more is drawn, which is a draw without replacement in proportion to exp(weight).

Weights are scored on arrays: a batch's words are numbered once, the CRC of a pair follows from the CRCs of its words by
tables, and gains are summed over ragged rows. The cutoff is found by weighted median of medians: chunks of the remaining
keys give their medians and sizes, the weighted median of these is a pivot with at least a quarter of the keys on either
side, and the side that cannot hold the cutoff is discarded. Only medians and counts reach the driver. Winners are
then sorted by range.

Null and empty texts have no features, weight 0, and are never drawn. Ties go to the smaller doc_id; a null doc_id is hashed as
the empty string and comes after all others of its score; rows that repeat a doc_id are told apart by n_features, then
by their place in the table written here, and each may be drawn. An empty corpus gives an empty result; an empty target gives
every feature's bucket the gain of no target counts. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.ordinals import numbered
from urbanpulse.llm.text import Memory, ragged_sum, text_slices
from urbanpulse.session import materialise

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
LONGEST = 64  # bytes of a word whose CRC is shifted by table; longer ones are hashed whole
CHUNK = 200_000  # keys of which a median is taken at a time
FEW = 20_000  # keys that the driver may sort
KEY = ("score", "doc_id", "n_features", "place")

ORDINARY = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case; everything in ASCII but letters and digits separates."""
    return text.encode("utf-8", "surrogatepass").translate(ORDINARY).split()


def shift_tables() -> np.ndarray:
    """tables[n, k, b]: what byte k with value b of a CRC-32 becomes when n bytes of any text follow."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part of one step
    tables = np.zeros((LONGEST + 2, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONGEST + 2):
        before = tables[n - 1]
        tables[n] = (before >> np.uint32(8)) ^ one[before & np.uint32(255)]
    return tables


def describe(pieces: list[bytes]) -> np.ndarray:
    """crc of the word, crc of a space and the word, bytes that these are."""
    return np.array([(zlib.crc32(p), zlib.crc32(b" " + p), len(p) + 1) for p in pieces], np.int64).reshape(-1, 3)


class Features:
    """Buckets of all features of a list of texts, as one ragged array."""

    def __init__(self):
        self.known, self.tables = Memory(describe), shift_tables()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, features per text, words per text); a text's words come first, then its pairs."""
        split = [words(t) for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        pieces = [w for s in split for w in s]
        told = self.known(pieces)
        own = np.repeat(np.arange(len(n)), n)
        left = np.flatnonzero(own[:-1] == own[1:]) if len(own) else own
        first, tail, size = told[left, 0].astype(np.uint32), told[left + 1, 1].astype(np.uint32), told[left + 1, 2]
        short = np.minimum(size, LONGEST + 1)
        pair = tail.copy()
        for k in range(4):
            pair ^= self.tables[short, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(size > LONGEST + 1):
            pair[i] = zlib.crc32(b" " + pieces[left[i] + 1], int(first[i]))
        whose = np.concatenate([own, own[left]])
        order = np.argsort(whose, kind="stable")
        buckets = (np.concatenate([told[:, 0], pair.astype(np.int64)]) % BUCKETS)[order]
        return buckets, n + np.maximum(n - 1, 0), n


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n of the features of all texts; each task adds its own up first."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros(BUCKETS, np.int64)
        for _, texts in text_slices(batches):
            total += np.bincount(features(texts)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """One gain a bucket, from the features of all documents and of all target texts; BUCKETS rows reach the driver."""
    source, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(t).collect()} for t in (docs, target))
    s_all, t_all = sum(source.values()) + BUCKETS, sum(wanted.values()) + BUCKETS
    return np.array([math.floor(1000 * math.log((wanted.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all)))
                     for b in range(BUCKETS)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored Gumbel noise in thousandths, drawn from the doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document."""
    gain = gains(docs, target)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part, texts in text_slices(batches):
            buckets, n, n_words = features(texts)
            weight = np.where(n > 0, ragged_sum(gain[buckets], n) // np.maximum(n, 1), 0)
            ids = part.column("doc_id")
            added = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, n_words, weight, added))],
                                             ["doc_id", "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Chunks of keys as rows of numbers that sort from the best on: score downwards, then doc_id (null last), then the rest."""
    held, n = [], 0
    for batch in batches:
        ids = batch.column("doc_id")
        columns = [-batch.column("score").to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                   ids.fill_null(0).to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy(zero_copy_only=False) for c in KEY[2:])]
        held.append(np.stack(columns, axis=1))
        n += batch.num_rows
        if n >= CHUNK:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


KEY_NAMES = ("k0", "k1", "k2", "k3", "k4")
KEY_SQL = ", ".join(f"{k} long" for k in KEY_NAMES)


def in_order(table: np.ndarray) -> np.ndarray:
    return table[np.lexsort(table.T[::-1])]


def chunk_medians(rows: DataFrame) -> list[tuple[tuple, int]]:
    """(median key, keys) of every chunk."""
    def medians(batches):
        for table in keys(batches):
            middle = in_order(table)[(len(table) - 1) // 2]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*middle, len(table))], [*KEY_NAMES, "n"])

    found = rows.select(*KEY).mapInArrow(medians, f"{KEY_SQL}, n long").collect()
    return [(tuple(r)[:5], r["n"]) for r in found]


def sort_key() -> list:
    """The columns of a key, in the order in which keys are compared."""
    return [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("n_features"), F.col("place")]


def before(key: tuple, inclusive: bool = False):
    """Keys that come before a key, or are it."""
    here = F.struct(*[c.cast("long").alias(k) for c, k in zip(sort_key(), KEY_NAMES)])
    there = F.struct(*[F.lit(x).cast("long").alias(k) for x, k in zip(key, KEY_NAMES)])
    return here <= there if inclusive else here < there


def weighted_median(pairs: list[tuple[tuple, int]]) -> tuple:
    total, seen = sum(n for _, n in pairs), 0
    for key, n in sorted(pairs):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


def cutoff(rows: DataFrame, wanted: int) -> tuple | None:
    """The key with number `wanted`, counted from 1 and from the best; None if that is 0. rows: KEY, all different.

    A round keeps a side of the pivot as a filter; remaining keys are written anew once three quarters of those last written
    are gone, so all rounds together read a few times the first table.
    """
    if not wanted:
        return None
    left, written = rows, rows.count()
    remaining = written
    while remaining > FEW:
        pivot = weighted_median(chunk_medians(left))
        at = left.where(before(pivot, inclusive=True)).count()
        if at == wanted:
            return pivot
        if at > wanted:
            left, remaining = left.where(before(pivot)), at - 1
            if wanted > remaining:
                return pivot
        else:
            left, remaining, wanted = left.where(~before(pivot, inclusive=True)), remaining - at, wanted - at
        if remaining * 4 < written:
            left, written = materialise(left), remaining
    found = in_order(np.concatenate([t for t in keys(left.select(*KEY).toArrow().to_batches())]))
    return tuple(int(x) for x in found[wanted - 1])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn."""
    rows = materialise(scored(docs, target, seed).withColumn("place", F.monotonically_increasing_id()))
    fit = rows.where(F.col("n_words") >= MIN_WORDS)
    last = cutoff(fit.select(*KEY), fit.count() * percent // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= MIN_WORDS) & before(last, inclusive=True)
    winners = numbered(rows.where(won), sort_key(), "rank")
    return winners.select(*out, (F.col("rank") + 1).alias("rank")).unionByName(
        rows.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns; doc_id must tell documents apart."""
    ids = resample(docs, target, percent, seed).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")
