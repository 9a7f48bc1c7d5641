"""Whole texts as ragged arrays: documents are cut into pieces, each distinct piece is looked at once."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

# Characters of text that are held as Python strings at a time.
SLICE_CHARS = 3_000_000
# Distinct pieces remembered by a task before it starts afresh; a bound on memory, not on results.
REMEMBERED = 400_000

ODD_SPACES = re.compile("[\x1c-\x1f]")
# Characters with the White_Space property; a fixed list.
SPACES = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE_RUN = re.compile(f"[{SPACES}]+")


def kept(key: tuple, make: Callable[[], object]) -> object:
    """Make a value once in each Python process: functions travel by value, so module globals do not outlive a task."""
    store = sys.__dict__.setdefault("_urbanpulse_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


class Slots(dict):
    """Numbers pieces in the order in which they are first met."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Memory:
    """Slots, and one array of properties for them that grows with new pieces."""

    def __init__(self, describe: Callable[[list[str]], np.ndarray], limit: int = REMEMBERED):
        self.describe, self.limit = describe, limit
        self.slots, self.values = Slots(), None

    def __call__(self, pieces: list[str]) -> np.ndarray:
        """One row of properties for each piece."""
        if len(self.slots) > self.limit:
            self.slots, self.values = Slots(), None
        known = len(self.slots)
        at = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        if not len(at):
            return self.describe([])
        if len(self.slots) > known:
            new = list(self.slots)[known:] if known < len(self.slots) // 2 else last_keys(self.slots, len(self.slots) - known)
            rows = self.describe(new)
            self.values = rows if self.values is None else np.concatenate([self.values, rows])
        return self.values[at]


def last_keys(table: dict, n: int) -> list[str]:
    """The n keys added last, in the order of adding."""
    keys = reversed(table)
    return [next(keys) for _ in range(n)][::-1]


def space_split(text: str) -> list[str]:
    """Pieces between white space in the sense of Unicode's White_Space property."""
    if ODD_SPACES.search(text):
        return [p for p in SPACE_RUN.split(text) if p]
    return text.split()


def slices(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows that hold about `most` characters; a longer text is a range of its own."""
    begin = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, row
            begin, held = row, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with their texts as strings; null is the empty text."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = [x or 0 for x in pa.compute.binary_length(sizes).to_pylist()]
        for a, b in slices(lengths, most):
            part = batch.slice(a, b - a)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def ragged_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to zero."""
    ends = np.cumsum(lengths)
    totals = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return totals[ends] - totals[ends - lengths]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive elements: starts[0] .. +lengths[0], then starts[1] .. and so on."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    return np.arange(total) + shift
