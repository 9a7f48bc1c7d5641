"""A minimal acyclic transducer from words to ids, held in one memory-mapped file.

Words that share endings share states; numbers on the arcs sum up to the word's place in the
sorted lexicon, which points at its ids. Arcs lie in a double array (base, owner, target,
number), so that a whole batch of words is walked one character at a time in numpy.
"""

from __future__ import annotations

import numpy as np

ARRAYS = ("base", "owner", "target", "number", "final", "start", "ids")


def minimal_states(words: list[bytes]) -> list[tuple[bool, list[tuple[int, int]]]]:
    """States (final, arcs) of the smallest automaton of sorted distinct words; the last is the root."""
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    known: dict[tuple, int] = {}

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(states)
            states.append((final, arcs))
        return known[key]

    path: list[list] = [[False, [], 0]]  # final, settled arcs, label that led here
    previous = b""
    for word in words:
        common = 0
        for a, b in zip(previous, word):
            if a != b:
                break
            common += 1
        while len(path) - 1 > common:
            final, arcs, label = path.pop()
            path[-1][1].append((label, settle(final, arcs)))
        for label in word[common:]:
            path.append([False, [], label])
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        final, arcs, label = path.pop()
        path[-1][1].append((label, settle(final, arcs)))
    states.append((path[0][0], path[0][1]))
    return states


def compile_lexicon(words: list[str], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file's bytes. words: distinct, in any order; ids: those of each word end to end, `lengths` of each."""
    raw = [w.encode() for w in words]
    order = sorted(range(len(raw)), key=raw.__getitem__)
    starts = np.cumsum(lengths) - lengths
    id_rows = [ids[starts[i]:starts[i] + lengths[i]] for i in order]
    states = minimal_states([raw[i] for i in order])
    paths = [0] * len(states)
    for state, (final, arcs) in enumerate(states):  # targets come before their sources
        paths[state] = final + sum(paths[t] for _, t in arcs)
    room = sum(len(arcs) + 256 * (len(arcs) > 1) for _, arcs in states) + 512
    owner, target, number = [-1] * room, [0] * room, [0] * room
    base = np.zeros(len(states), np.int32)
    lowest = highest = 0
    for state in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        final, arcs = states[state]
        if not arcs:
            continue
        labels = [c for c, _ in arcs]
        at = lowest - labels[0]  # may be negative: only base + label is ever looked up
        tries = 0
        while any(owner[at + c] >= 0 for c in labels):
            tries += 1
            at = at + 1 if tries < 64 else max(at + 1, highest - labels[0])
        highest = max(highest, at + labels[-1] + 1)
        base[state] = at
        before = int(final)
        for c, t in arcs:
            owner[at + c], target[at + c], number[at + c] = state, t, before
            before += paths[t]
        while owner[lowest] >= 0:
            lowest += 1
    used = highest + 256  # a label past the last arc finds no owner
    parts = {
        "base": base,
        **{n: np.array((x + [-1] * 256)[:used], np.int32) for n, x in (("owner", owner), ("target", target), ("number", number))},
        "final": np.array([f for f, _ in states], np.int32),
        "start": np.concatenate([[0], np.cumsum([len(r) for r in id_rows])]).astype(np.int32),
        "ids": np.concatenate([*id_rows, np.zeros(0)]).astype(np.int32),
    }
    sizes = np.array([len(parts[a]) for a in ARRAYS], np.int32)
    return b"".join([sizes.tobytes(), *[parts[a].tobytes() for a in ARRAYS]])


class Lexicon:
    """The transducer, read through a memory map that all workers of a machine share."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int32, mode="r")
        at = len(ARRAYS)
        for name, size in zip(ARRAYS, data[:at].tolist()):
            setattr(self, name, data[at:at + size])
            at += size

    def find(self, words: list[str]) -> np.ndarray:
        """The place of each word in the sorted lexicon; -1 where it is not in it."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(lengths) - lengths
        place = np.full(len(raw), -1, np.int64)
        rows, state, total = np.arange(len(raw)), np.full(len(raw), len(self.base) - 1), np.zeros(len(raw), np.int64)
        step = 0
        while len(rows):
            end = lengths[rows] == step
            if end.any():
                accepted = end & (self.final[state] > 0)
                place[rows[accepted]] = total[accepted]
                rows, state, total = rows[~end], state[~end], total[~end]
            slot = self.base[state].astype(np.int64) + data[starts[rows] + step]
            on = self.owner[slot] == state
            rows, slot, total = rows[on], slot[on], total[on]
            total = total + self.number[slot]
            state = self.target[slot].astype(np.int64)
            step += 1
        return place
