"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

Test items are partitioned by size: items of q to 2q shingles form a band. A short item cannot be
found in a long text by the MinHash of the whole text, so for each band texts are divided into blocks
of the band's upper size, and each pair of neighbouring blocks is a window: its minima are those of
its blocks. An item and a window are candidates when one of HASHES minima is equal. However an
item's shingles are scattered, each lies in some window of at most four times the item's size, and
when it is the item's minimum it is the window's about once in five draws at least. So 56 draws
miss an item that is contained to 0.8 with a chance below one in 100,000, and one that is contained as a whole with
one below one in ten million. Candidates are then verified by exact containment of word shingles in the whole text.

Words stand between white space, lower-cased and without all that is no letter or digit; a shingle is five words. An item of fewer words
is one shingle of all of them. Items without words are found nowhere, nor is anything in
null or empty texts. Rows that repeat a doc_id or an item_id are treated each; further columns of
either table are ignored; empty tables give an empty result or one without findings. Items with a null item_id
are not part of the result.

Items are taken in blocks of about ITEMS: each block is broadcast, and the tasks that read the documents search
for one block after the other. Nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.text import Memory, ragged_sum, text_slices

WORDS = 5
CONTAINED = 0.8
HASHES = 56
ITEMS = 20_000
SLICE_CHARS = 600_000

OTHER = regex.compile(r"[^\p{L}\p{N}]+")
SEEDS = (np.random.default_rng(6).integers(1, 2**63, HASHES, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    mixed = (data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    return total[starts + lengths] - total[starts]


def plain(piece: str) -> str:
    return piece if piece.isalnum() else OTHER.sub("", piece)


def words_of(text: str) -> list[str]:
    return [w for p in text.lower().split() if (w := plain(p))]


def piece_hashes(pieces: list[str]) -> np.ndarray:
    """Hash of each piece's word; 0 for a piece without letters and digits."""
    return word_hashes([plain(p) for p in pieces])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k]
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES rows of the least value in each block."""
    return np.stack([np.minimum.reduceat(hashes * s, starts) for s in SEEDS])


class Items:
    """Test items by shingle width and size band, with the minima of each."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.shingles, bands = [], [], defaultdict(list)
        self.memory = Memory(piece_hashes)
        for item, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            width = min(WORDS, len(words))
            hashes = np.unique(shingle_hashes(word_hashes(words), width))
            bands[width, len(hashes).bit_length()].append(len(self.ids))
            self.ids.append(item)
            self.shingles.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)})
            bands[width, len(hashes).bit_length(), "minima"].append(minima(hashes, np.zeros(1, np.int64))[:, 0])
        self.bands = []
        for key in [k for k in bands if len(k) == 2]:
            values = np.stack(bands[(*key, "minima")], axis=1)
            order = np.argsort(values, axis=1)
            self.bands.append((key[0], 1 << key[1], np.take_along_axis(values, order, 1), np.array(bands[key])[order]))

    def candidates(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) pairs of which some window and the item share a minimum."""
        found: set[tuple[int, int]] = set()
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        for width, size, values, items in self.bands:
            hashes = shingle_hashes(words, width)
            if not len(hashes):
                continue
            place = np.arange(len(hashes)) - (ends - lengths)[owner[:len(hashes)]]
            whole = owner[:len(hashes)] == owner[width - 1:]  # shingles that do not cross documents
            hashes, place, doc = hashes[whole], place[whole], owner[:len(whole)][whole]
            if not len(hashes):
                continue
            block = place // size
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]))
            least, doc = minima(hashes, starts), doc[starts]
            joined = doc[1:] == doc[:-1]
            windows = np.where(joined, np.minimum(least[:, 1:], least[:, :-1]), least[:, 1:])
            windows = np.concatenate([least[:, :1], windows], axis=1)
            for own, known, item in zip(windows, values, items):
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                hits = np.flatnonzero(known[at] == own)
                for h in hits.tolist():
                    k = int(at[h])
                    while k < len(known) and known[k] == own[h]:  # items with the same minimum
                        found.add((int(doc[h]), int(item[k])))
                        k += 1
        return iter(sorted(found))

    def search(self, texts: list[str]) -> list[list[int]]:
        """Ids of the items that each text contains."""
        pieces = [t.lower().split() for t in texts]
        hashes = self.memory([p for ps in pieces for p in ps])
        lengths = np.array([len(ps) for ps in pieces], np.int64)
        word = hashes != 0
        lengths = ragged_sum(word.astype(np.int64), lengths)
        out: list[list[int]] = [[] for _ in texts]
        shingles: tuple[int, int, set] = (-1, 0, set())
        for doc, item in sorted(self.candidates(hashes[word], lengths), key=lambda p: (p[0], self.width(p[1]))):
            width = self.width(item)
            if shingles[:2] != (doc, width):
                own = words_of(texts[doc])
                shingles = (doc, width, set(zip(*[own[k:] for k in range(width)])))
            wanted = self.shingles[item]
            if len(wanted & shingles[2]) >= CONTAINED * len(wanted):
                out[doc].append(self.ids[item])
        return [sorted(x) for x in out]

    def width(self, item: int) -> int:
        return len(next(iter(self.shingles[item])))


def search_batches(batches, rows: list[tuple[int, str]]):
    """Adds this block's items to those found before."""
    items = Items(rows)
    for part, texts in text_slices(batches, most=SLICE_CHARS):
        found = [sorted(a + b) for a, b in zip(part.column("item_ids").to_pylist(), items.search(texts))]
        yield part.set_column(2, "item_ids", pa.array(found, pa.list_(pa.int64())))


def broadcast_blocks(benchmark: DataFrame, block: int) -> Iterator[Broadcast]:
    """The items, `block` of them at a time through the driver."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, -(-items.count() // block))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])


def contained_items(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """doc_id, n_items, item_ids (sorted) and contaminated of every document."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.array().cast("array<long>").alias("item_ids"))
    for sent in broadcast_blocks(benchmark, block):
        found = found.mapInArrow(lambda b, sent=sent: search_batches(b, sent.value), "doc_id long, text string, item_ids array<long>")
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                        (F.size("item_ids") > 0).alias("contaminated"))


def clean_batches(batches, rows: list[tuple[int, str]], column: str):
    items = Items(rows)
    for part, texts in text_slices(batches, column, SLICE_CHARS):
        yield part.filter(pa.array([not own for own in items.search(texts)], pa.bool_()))


def without_items(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose text contains no item; nothing is shuffled."""
    left = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{[c.lower() for c in docs.columns].index('text')}"
    for sent in broadcast_blocks(benchmark, block):
        left = left.mapInArrow(lambda b, sent=sent: clean_batches(b, sent.value, text), left.schema)
    return left.toDF(*docs.columns)
