"""Removal of repeated 50-byte strings by bucket-pointer refinement (operator 10).

A bucket holds the places whose next bytes are equal. Buckets of 1-grams are refined to 2, 4, 8,
16, ... bytes: a place's new bucket is named by its bucket and the bucket at a later offset, and
each refinement is reused by the next. Names are computed from the contents, so every task gives
the same bucket the same name, and only buckets that hold several documents are refined further:

1. Every 50-byte string is filed under one of its 20-grams, the one of least rank, so a text
   shows up in the exchange with about one place in 15 (its anchors), and a bucket that
   lies in one document only is finished there.
2. Places of a shared bucket are refined to the whole surroundings that strings filed there can
   reach. If a smaller document has the same surroundings, all these strings go.
3. The rest, mostly the ends of repeated passages, is refined to the 50-byte strings themselves.

A task settles what is equal among its own documents first and sends one entry for each bucket, each kind of
surroundings and each string, so that even of a passage in a third of all documents no task receives more
entries than there are batches. Entries travel packed: those of one batch and one part are sorted,
their names differenced and compressed.
All steps read the input texts, never what is left of them.

Null and empty texts have nothing to remove. Rows with a null doc_id neither remove nor lose
anything; rows that repeat a doc_id count as that document and do not remove each other. Only
doc_id and text are read, so further columns do not matter; an empty table gives an empty result.
Names are 64-bit hashes of 50 bytes (48 bits among the surroundings of one bucket).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.packing import dealt, mix, packed_parts, whole_parts
from urbanpulse.llm.text import runs, slices
from urbanpulse.session import materialise

SPAN = 50
GRAM = 20
WIDTH = SPAN - GRAM + 1  # 16-grams in a string
PLACE_BITS = np.uint64(31)
PLACE = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
NAME = (1 << 48) - 1
SLICE_BYTES = 1 << 20

ALONE, MARK, SETTLED = 0, 1, 2  # kinds of rows sent
ALL_GO, REFINE = 0, 1  # what is known of surroundings


class Places:
    """The bytes of some documents end to end, their buckets and anchors."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.lengths) - self.lengths
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        self.buckets, size = {1: mix(data, data)}, 1
        while size < 64:
            finer = self.buckets[size].copy()
            if len(data) > size:
                finer[:-size] = mix(self.buckets[size][:-size], self.buckets[size][size:])
            self.buckets[2 * size] = finer
            size *= 2
        strings = np.maximum(self.lengths - SPAN + 1, 0)
        self.strings = runs(self.starts, strings)  # where 50-byte strings begin
        self.doc = np.repeat(np.arange(len(raw)), strings)
        rank = self.gram_buckets() * np.uint64(0xD6E8FEB86659FD93)
        least = ((rank >> PLACE_BITS) << PLACE_BITS) | np.arange(len(data), dtype=np.uint64)
        size = 1
        while 2 * size <= WIDTH and len(least) > size:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < WIDTH and len(least) > WIDTH - size:
            least = np.minimum(least[:size - WIDTH], least[WIDTH - size:])
        filed = (least[self.strings] & PLACE).astype(np.int64) if len(self.strings) else self.strings
        new = np.concatenate([[True], filed[1:] != filed[:-1]]) if len(filed) else np.zeros(0, bool)
        self.anchor, self.anchor_doc = filed[new], self.doc[new]
        self.of_string = np.cumsum(new) - 1  # the anchor that each string is filed under

    def gram_buckets(self) -> np.ndarray:
        """Buckets of the q-grams at all places: 16 bytes, refined by those that follow."""
        out = self.buckets[16].copy()
        if len(out) > 16:
            out[:-16] = mix(out[:-16], self.buckets[GRAM - 16][16:])
        return out

    def name(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Names of byte ranges of 16 to 127 bytes: two buckets that overlap."""
        out = np.zeros(len(start), np.uint64)
        for size in (16, 32, 64):
            at = (length >= size) & (length < 2 * size)
            out[at] = mix(self.buckets[size][start[at]], self.buckets[size][start[at] + length[at] - size] + length[at].astype(np.uint64))
        return out

    def surroundings(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each anchor's 16-gram and name of all that strings filed there can reach."""
        begin = np.maximum(self.starts[self.anchor_doc], self.anchor - WIDTH + 1)
        end = np.minimum((self.starts + self.lengths)[self.anchor_doc], self.anchor + SPAN)
        where = mix(self.anchor.astype(np.uint64) - begin.astype(np.uint64), self.name(begin, end - begin))
        gram = self.gram_buckets()[self.anchor]
        return (gram & np.uint64(NAME)).astype(np.int64), (mix(gram, where) & np.uint64(NAME)).astype(np.int64)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def byte_slices(batches, most: int = SLICE_BYTES):
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
        for a, b in slices(lengths, most):
            yield batch.slice(a, b - a)


def settle(gram: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (gram, name, kind, doc) of one task: equal surroundings are settled, buckets of several kinds marked."""
    order = np.lexsort((doc, name, gram))
    gram, name, doc = gram[order], name[order], doc[order]
    same = np.concatenate([[False], (gram[1:] == gram[:-1]) & (name[1:] == name[:-1])])
    first = ~same
    least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = same & (doc != np.concatenate([[0], doc[:-1]])) & (doc > least)
    head = np.flatnonzero(first)
    g, n, d = gram[head], name[head], doc[head]
    opens = np.concatenate([[True], g[1:] != g[:-1]])
    kinds = np.diff(np.append(np.flatnonzero(opens), len(g)))
    several = np.repeat(kinds > 1, kinds)
    marks = opens & several
    # settled rows and rows of buckets of several kinds need their surroundings only, not the bucket's other rows
    kind = np.where(several, SETTLED + REFINE, ALONE)
    return (np.concatenate([g, g[marks], gram[later]]), np.concatenate([n, n[marks], name[later]]),
            np.concatenate([kind, np.full(marks.sum(), MARK), np.full(later.sum(), SETTLED + ALL_GO)]),
            np.concatenate([d, d[marks], doc[later]]))


def anchor_rows(batches, parts: int):
    for batch in batches:
        grams, names, docs = [], [], []
        for piece in byte_slices([batch]):
            places = Places(raw_texts(piece.column("text")))
            gram, name = places.surroundings()
            grams.append(gram)
            names.append(name)
            docs.append(piece.column("doc_id").to_numpy()[places.anchor_doc])
        if grams and sum(map(len, grams)):
            gram, name, kind, doc = settle(np.concatenate(grams), np.concatenate(names), np.concatenate(docs))
            g, n, k = gram.astype(np.uint64), name.astype(np.uint64), kind.astype(np.uint64)
            spread = np.where(kind >= SETTLED, mix(g, n), mix(g, g)) % np.uint64(parts)
            yield packed_parts(spread.astype(np.int64), g, n * np.uint64(4) + k, doc)


def judge(gram: np.ndarray, name: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, name, verdict) from whole buckets, sorted by gram, name and doc."""
    done = kind == SETTLED + ALL_GO
    live = kind != MARK
    opens = np.concatenate([[True], gram[1:] != gram[:-1]])
    bucket = np.cumsum(opens) - 1
    starts = np.flatnonzero(opens)
    group = np.concatenate([[True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])])
    kinds = np.add.reduceat(group.astype(np.int64), starts)
    marked = np.maximum.reduceat((kind == MARK) | (kind == SETTLED + REFINE), starts)
    least = np.minimum.reduceat(np.where(live, doc, np.iinfo(np.int64).max), np.flatnonzero(group))[np.cumsum(group) - 1]
    goes = live & (done | (doc > least))
    refine = live & ~goes & ((kinds[bucket] > 1) | marked[bucket])
    keep = goes | refine
    return doc[keep], name[keep], np.where(goes, ALL_GO, REFINE)[keep]


def judged_rows(batches):
    for gram, packed, doc in whole_parts(batches):
        name = packed >> np.uint64(2)
        order = np.lexsort((doc, name, gram))
        kind = (packed & np.uint64(3)).astype(np.int64)
        doc, name, verdict = judge(gram[order], name[order], kind[order], doc[order])
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name.astype(np.int64) * 2 + verdict)], ["doc_id", "verdict"])


def covered(places: Places, gone: np.ndarray) -> np.ndarray:
    """Bytes under the 50-byte strings that begin where `gone` says."""
    change = np.zeros(int(places.lengths.sum()) + 1, np.int32)
    np.add.at(change, gone, 1)
    np.subtract.at(change, gone + SPAN, 1)
    return np.cumsum(change)[:-1] > 0


def outcome(places: Places, hidden: np.ndarray) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, digest of what is kept, of each document."""
    out = []
    for raw, start, length in zip(places.raw, places.starts.tolist(), places.lengths.tolist()):
        gone = hidden[start:start + length]
        removed = int(gone.sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if removed else raw
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if removed else 0
        out.append((length, removed, spans, hashlib.sha256(kept).hexdigest()))
    return out


def looked_at(batch: pa.RecordBatch):
    """Slices of a batch: places, strings that go by the verdicts, strings that are left open."""
    unsqueeze = zstandard.ZstdDecompressor().decompress
    raws = [unsqueeze(b) if b else b"" for b in batch.column("text").to_pylist()]
    for a, b in slices([len(r) for r in raws], SLICE_BYTES):
        piece, places = batch.slice(a, b - a), Places(raws[a:b])
        name = places.surroundings()[1]
        lists = piece.column("verdicts")
        said = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(b - a), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
        known = mix(owner.astype(np.uint64), (said >> 1).astype(np.uint64))
        here = mix(places.anchor_doc.astype(np.uint64), name.astype(np.uint64))
        goes = np.isin(here, known[said % 2 == ALL_GO])
        opens = np.isin(here, known[said % 2 == REFINE]) & ~goes
        yield piece, places, places.strings[goes[places.of_string]], np.flatnonzero(opens[places.of_string])


def string_names(places: Places, at: np.ndarray) -> np.ndarray:
    return places.name(places.strings[at], np.full(len(at), SPAN))


def string_rows(batches, parts: int):
    """The open 50-byte strings; of equal ones in a batch only the smallest document's, and who loses to it."""
    for batch in batches:
        names, docs = [], []
        for piece, places, _, opens in looked_at(batch):
            names.append(string_names(places, opens))
            docs.append(piece.column("doc_id").to_numpy()[places.doc[opens]])
        if names and sum(map(len, names)):
            name, doc = np.concatenate(names), np.concatenate(docs)
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            again = np.concatenate([[False], (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])])
            name, doc = name[~again], doc[~again]
            first = np.concatenate([[True], name[1:] != name[:-1]])
            spread = np.where(first, name, mix(name, doc.astype(np.uint64))) % np.uint64(parts)
            yield packed_parts(spread.astype(np.int64), name, ~first, doc)


def lost_strings(batches):
    for name, lost, doc in whole_parts(batches):
        order = np.lexsort((doc, lost, name))
        name, lost, doc = name[order], lost[order] > 0, doc[order]
        first = np.concatenate([[True], name[1:] != name[:-1]])
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        gone = lost | (doc > least)
        yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(name[gone].view(np.int64))], ["doc_id", "name"])


def final_rows(batches):
    """Take out what goes, of documents that have verdicts; others stay whole."""
    unsqueeze = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        said = pa.compute.is_valid(batch.column("verdicts"))
        whole = batch.filter(pa.compute.invert(said))
        raws = [unsqueeze(b) if b else b"" for b in whole.column("text").to_pylist()]
        yield result_batch(whole, [(len(r), 0, 0, hashlib.sha256(r).hexdigest()) for r in raws])
        for piece, places, gone, opens in looked_at(batch.filter(said)):
            lists = piece.column("gone")
            owner = np.repeat(np.arange(len(piece)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            lost = mix(owner.astype(np.uint64), lists.flatten().to_numpy().view(np.uint64))
            here = mix(places.doc[opens].astype(np.uint64), string_names(places, opens))
            more = places.strings[opens[np.isin(here, lost)]]
            yield result_batch(piece, outcome(places, covered(places, np.concatenate([gone, more]))))


def result_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, types)],
                                      ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def squeezed(batches):
    squeeze = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        blobs = [squeeze(t) if t else None for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "text"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * partitions
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = rows.where("doc_id IS NOT NULL").mapInArrow(lambda b: anchor_rows(b, parts), "part int, blob binary")
    judged = dealt(sent, partitions).mapInArrow(judged_rows, "doc_id long, verdict long")
    verdicts = materialise(judged.groupBy("doc_id").agg(F.collect_set("verdict").alias("verdicts")))
    # both uses below share one exchange of the texts
    texts = rows.mapInArrow(squeezed, "doc_id long, text binary").repartition(partitions, "doc_id")
    strings = texts.join(verdicts, "doc_id").mapInArrow(lambda b: string_rows(b, parts), "part int, blob binary")
    lost = dealt(strings, partitions).mapInArrow(lost_strings, "doc_id long, name long")
    gone = lost.groupBy("doc_id").agg(F.collect_list("name").alias("gone"))
    return texts.join(verdicts, "doc_id", "left").join(gone, "doc_id", "left").mapInArrow(final_rows, RESULT)
