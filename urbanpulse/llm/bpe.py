"""Byte-pair merges over ragged arrays, and the vocabulary files that name them."""

from __future__ import annotations

import json

import numpy as np

from urbanpulse.llm.text import kept

NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class PairTable:
    """(left id, right id) -> (rank, merged id), by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.merged = merged.astype(np.int32)
        bits = max(4, int(len(self.keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        waiting, at, self.probes = np.arange(len(self.keys)), self._home(self.keys), 0
        while len(waiting):
            free = self.table[at] < 0
            self.table[at[free]] = waiting[free]
            left_over = self.table[at] != waiting
            waiting, at = waiting[left_over], (at[left_over] + 1) & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out, at, rows = np.full(len(keys), NO_RANK, np.int32), self._home(keys), None
        for _ in range(self.probes):
            found = self.table[at]
            same = (found >= 0) & (self.keys[found] == keys)
            out[same if rows is None else rows[same]] = found[same]
            more = np.flatnonzero((found >= 0) & ~same)
            if not len(more):
                break
            rows = more if rows is None else rows[more]
            keys, at = keys[more], (at[more] + 1) & self.mask
        return out


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply merges to many sequences at once: in each round every sequence merges its own lowest-ranked pair.

    symbols: the sequences end to end; lengths: at least 1 each. Equal neighbouring pairs are taken from the
    left without overlap. Returns the remaining symbols end to end and their lengths, in the same order.
    """
    names = np.arange(len(lengths))
    symbols = symbols.astype(np.int32)
    lengths = lengths.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ranks = None
    while len(names):
        ends = np.cumsum(lengths)
        if ranks is None:
            ranks = np.full(len(symbols), NO_RANK, np.int32)
            ranks[:-1] = table.ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = NO_RANK
        best = np.minimum.reduceat(ranks, ends - lengths)
        over = best == NO_RANK
        if over.any():
            rest = np.repeat(~over, lengths)
            done.append((names[over], lengths[over], symbols[~rest]))
            names, lengths, best, symbols, ranks = names[~over], lengths[~over], best[~over], symbols[rest], ranks[rest]
            if not len(names):
                break
            ends = np.cumsum(lengths)
        hit = ranks == np.repeat(best, lengths)
        at = np.flatnonzero(hit)
        if len(at) > 1 and (close := np.diff(at) == 1).any():
            first = np.concatenate([[True], ~close])  # runs as in "aaa": every second pair
            order = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            at = at[order % 2 == 0]
        symbols[at] = table.merged[ranks[at]]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        lengths = lengths - np.add.reduceat(~stay, ends - lengths, dtype=np.int64)
        at = at - np.arange(len(at))
        symbols, ranks = symbols[stay], ranks[stay]
        ends = np.cumsum(lengths)
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        changed[at[at > 0] - 1] = True
        changed[ends - 1] = False
        ranks[ends - 1] = NO_RANK
        again = np.flatnonzero(changed)
        ranks[again] = table.ranks(symbols[again], symbols[again + 1])
    if not done:
        return symbols[:0], lengths[:0]
    order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
    lengths = np.concatenate([d[1] for d in done])
    symbols = np.concatenate([d[2] for d in done])
    starts = np.cumsum(lengths) - lengths
    take = lengths[order]
    shift = np.repeat(starts[order] - (np.cumsum(take) - take), take)
    return symbols[np.arange(len(symbols)) + shift], take


class Vocabulary:
    """Merges, tokens and special tokens of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        columns = np.array([[ids[a], ids[b], ids[a + b]] for a, b in pairs], np.int64).reshape(-1, 3)
        self.pairs = PairTable(columns[:, 0], columns[:, 1], columns[:, 2])
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.specials).items()}
        chars = byte_characters()
        self.of_byte = np.array([ids[c] for c in chars], np.int32)
        self.of_last = np.array([ids[c + self.suffix] for c in chars], np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty pre-tokens end to end, and how many each has: exact merges."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.of_byte[data]
        if self.suffix and len(data):
            last = np.cumsum(lengths) - 1
            symbols[last] = self.of_last[data[last]]
        return merge(self.pairs, symbols, lengths)


def vocabulary(path: str) -> Vocabulary:
    return kept(("vocabulary", path), lambda: Vocabulary(path))
