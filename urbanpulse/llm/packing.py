"""Entries (name, more, doc) that travel packed: those of one batch and one part in one compressed row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of the pair (a, b)."""
    out = b >> np.uint64(29)
    out ^= b
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out += a * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest ones, then all second ones and so on."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").reshape(n)


def pack(name: np.ndarray, more: np.ndarray, doc: np.ndarray) -> bytes:
    """Entries sorted by name."""
    docs, own = np.unique(doc, return_inverse=True)
    parts = [np.diff(name, prepend=np.uint64(0)), more.astype(np.uint64), own.astype(np.uint64), docs.view(np.uint64)]
    head = np.array([len(name), len(docs)], "<i8").tobytes()
    return head + zstandard.ZstdCompressor(1).compress(b"".join(map(planes, parts)))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, docs = np.frombuffer(blob[:16], "<i8").tolist()
    data = zstandard.ZstdDecompressor().decompress(blob[16:])
    name, more, own = (from_planes(data[8 * n * k:8 * n * (k + 1)], n) for k in range(3))
    return np.cumsum(name, dtype=np.uint64), more, from_planes(data[24 * n:], docs).view(np.int64)[own.astype(np.int64)]


def packed_parts(part: np.ndarray, name: np.ndarray, more: np.ndarray, doc: np.ndarray):
    """(part, blob) rows; part: where each entry goes."""
    order = np.lexsort((name, part))
    part, name, more, doc = part[order], name[order], more[order], doc[order]
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    blobs = [pack(name[a:b], more[a:b], doc[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def whole_parts(batches):
    """The entries of one part after the other, from rows sorted by part."""
    held, part = [], None
    for batch in batches:
        for own, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
            if own != part and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            part = own
            held.append(unpack(blob))
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def dealt(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartition(parts, "part").sortWithinPartitions("part")
