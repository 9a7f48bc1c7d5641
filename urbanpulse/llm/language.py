"""Language identification by cross-parsing entropy (operator 5).

For each language the distinct words of a bounded sample of labelled text are put into a suffix
automaton. A text is parsed against each automaton into the longest matches it gives, a match ending at
a word's end at the latest; the language that needs the fewest phrases, each weighed by the logarithm
of its automaton's length, wins. Parsing word by word lets a task parse every distinct word once,
and whole texts are sums over their words. Words are lower-cased and keep their letters only.

Learned are only labelled texts (text and lang not null) outside the held-out fold, at most CHARS
characters and DOCS documents of each language; automata are built on the driver from this bounded sample and broadcast.

A text that is null or has no letter is `und` with score 0, as is every text if nothing could be
learned. Ties go to the language that sorts first. Repeated rows are predicted each; columns other than doc_id, text and lang
are ignored; an empty table gives an empty result. A null doc_id counts as held out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanpulse.llm.bpe import PairTable
from urbanpulse.llm.samples import draw, held_out
from urbanpulse.llm.text import Memory, ragged_sum, text_slices

DOCS = 200  # labelled documents of a language
CHARS = 150_000  # characters of its distinct words
UNKNOWN = "und"
NO_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(piece: str) -> str:
    return piece if piece.isalpha() else NO_LETTERS.sub("", piece)


def suffix_automaton(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs (from, character, to) of the automaton of all substrings; state 0 is the root."""
    arcs: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    flat = [(s, ord(c), t) for s, own in enumerate(arcs) for c, t in own.items()]
    source, char, target = np.array(flat, np.int64).reshape(-1, 3).T
    return source.astype(np.int32), char.astype(np.int32), target.astype(np.int32)


class CrossParser:
    """Phrases that words need in each language."""

    def __init__(self, automata: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.tables = [PairTable(*a) for a in automata]

    def __call__(self, pieces: list[str]) -> np.ndarray:
        """For each piece: phrases in each language, then its letters."""
        words = [letters(p) for p in pieces]
        out = np.zeros((len(words), len(self.tables) + 1), np.int64)
        out[:, -1] = list(map(len, words))
        filled = np.flatnonzero(out[:, -1])
        if len(filled):
            marked = [f" {words[i]} " for i in filled]
            lengths = np.fromiter(map(len, marked), np.int64, len(marked))
            chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int32)
            for k, table in enumerate(self.tables):
                out[filled, k] = phrases(table, chars, lengths)
        return out


def phrases(table: PairTable, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Longest matches that each word is cut into, all words one character at a time."""
    order = np.argsort(-lengths, kind="stable")  # the words that still run stay in front
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    counts, state = np.ones(len(order), np.int64), np.zeros(len(order), np.int32)
    for step in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -step))  # words longer than step
        char, at = chars[starts[:n] + step], state[:n].copy()
        arc = table.ranks(at, char)
        stuck = np.flatnonzero(arc >= len(table.merged))
        state[:n] = table.merged[np.minimum(arc, len(table.merged) - 1)]
        if len(stuck):
            counts[stuck] += at[stuck] != 0  # a character unknown at the root is a phrase of its own
            again = table.ranks(np.zeros(len(stuck), np.int32), char[stuck])
            state[stuck] = np.where(again < len(table.merged), table.merged[np.minimum(again, len(table.merged) - 1)], 0)
            alone = again >= len(table.merged)
            counts[stuck[alone]] += step + 1 < sizes[stuck[alone]]
    out = np.empty(len(order), np.int64)
    out[order] = counts
    return out


def learn(docs: DataFrame, sample: int = DOCS, chars: int = CHARS) -> list[tuple[str, int, tuple]]:
    """(language, characters, automaton) of each learned language, from a bounded sample."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bounds = known.select("lang", draw().alias("h")).withColumn("nth", nth).where(F.col("nth") <= sample)
    chosen = [(r.lang, r.h) for r in bounds.groupBy("lang").agg(F.max("h").alias("h")).collect()]
    learned = []
    for lang, bound in sorted(chosen):
        texts = known.where((F.col("lang") == lang) & (draw() <= bound)).orderBy(draw(), "text").limit(sample).select("text")
        words: dict[str, None] = {}
        size = 0
        for row in texts.toLocalIterator():
            for piece in row.text.lower().split():
                word = letters(piece)
                if word and word not in words and size + len(word) < chars:
                    words[word] = None
                    size += len(word) + 1
            if size >= chars * 0.99:
                break
        if words:
            text = f" {' '.join(words)} "
            learned.append((lang, len(text), suffix_automaton(text)))
    return learned


def predict_batches(batches, learned):
    names, weights = [x[0] for x in learned], np.array([math.log2(x[1] + 2) for x in learned])
    memory = Memory(CrossParser([x[2] for x in learned]))
    for part, texts in text_slices(batches):
        pieces = [t.lower().split() for t in texts]
        totals = ragged_sum(memory([p for ps in pieces for p in ps]), np.array([len(ps) for ps in pieces], np.int64))
        cost = totals[:, :-1] * weights
        best = cost.argmin(axis=1) if names else np.zeros(len(texts), int)
        lang = [names[b] if names and n else UNKNOWN for b, n in zip(best.tolist(), totals[:, -1].tolist())]
        score = [0.0] * len(texts)
        if names:
            share = np.exp(np.maximum(cost.min(axis=1, keepdims=True) - cost, -700)).sum(axis=1)
            score = np.where(totals[:, -1] > 0, 1 / share, 0.0)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, sample: int = DOCS, chars: int = CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, sample, chars))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(lambda b: predict_batches(b, sent.value), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
