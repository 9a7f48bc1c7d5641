"""Quality classification from weak labels (operator 8).

Heuristic labellers vote good (1), bad (2) or nothing (0) on every document; they overlap and
err. The documents are counted by their votes (at most 3 ** labellers patterns, whatever the corpus), and
expectation-maximisation on these counts estimates how each labeller votes on good and on bad documents,
hence the chance that a document with given votes is good. These posterior labels of a bounded sample
train a linear scorer over hashed shapes of words, which then judges every document.

The labellers share no labels with anyone: the table `labels` is not read. A document is rejected
if its score, the chance of being good, is below 0.5. Null and empty texts score 0. Repeated rows are
judged each; rows keep all their columns in `accepted`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.samples import hash_sample
from urbanpulse.llm.text import Memory, ragged_sum, text_slices

SAMPLE = 4_000  # documents that train the scorer
SLICE_CHARS = 1_000_000  # of texts looked at at a time
REMEMBERED = 100_000  # words whose properties a task keeps; others are looked at again
BINS = 2_048
ROUNDS = 60
GOOD, BAD = 1, 2

# Frequent function words of the languages at hand; fixed values.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be this by der die das und in den von zu mit ist nicht ein eine "
    "de la le les et des est un une du que pour el los las y del se por con no una es en".split())
SHAPES = [(re.compile(r"[^\W\d_]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1+")]

LABELLERS = ("symbols", "capitals", "neighbours", "variety", "letters", "word_length", "function_words", "sentences", "separators", "echo")


def shape(piece: str) -> str:
    """Letters as x or X, digits as 9, runs of a sign as one and a plus."""
    if piece.isalpha():
        return "x" if piece.islower() else "Xx" if piece[1:].islower() else "X"
    letters = [c for c in piece if c.isalpha()]
    out = piece
    for pattern, short in SHAPES:
        out = pattern.sub(short, out)
    return ("X" if letters and all(map(str.isupper, letters)) and len(letters) > 1 else "") + out


def describe(pieces: list[str]) -> np.ndarray:
    """For each piece: identity, length, letters, capitals, ends in two signs, function word, ends a sentence, bin of its shape, without letters and digits."""
    return np.array([one(p) for p in pieces], np.int64).reshape(-1, 9)


def one(piece: str) -> tuple[int, ...]:
    code = zlib.crc32(piece.encode()) | len(piece) << 32
    if piece.isalpha() and piece.islower():
        return code, len(piece), len(piece), 0, 0, piece in FUNCTION_WORDS, 0, zlib.crc32(b"x") % BINS, 0
    letters, capitals = sum(map(str.isalpha, piece)), sum(map(str.isupper, piece))
    tail = len(piece) - len(piece.rstrip("!#$%&*+=@^~|<>?-_"))
    word = piece.strip(".,!?;:").lower()
    return code, len(piece), letters, capitals, tail >= 2, word in FUNCTION_WORDS, piece[-1] in ".!?", zlib.crc32(shape(piece).encode()) % BINS, not any(map(str.isalnum, piece))


class Pieces:
    """What the labellers and the scorer look at, for the texts of a slice."""

    def __init__(self, memory: Memory, texts: list[str]):
        pieces = [t.split() for t in texts]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.rows = memory([p for ps in pieces for p in ps])
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        code = self.rows[:, 0]
        self.again = np.zeros(len(code), bool)
        self.again[1:] = (code[1:] == code[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.echo = np.zeros(len(code), bool)
        self.echo[2:] = (code[2:] == code[:-2]) & (self.doc[2:] == self.doc[:-2])

    def votes(self) -> np.ndarray:
        """One column for each labeller."""
        n = np.maximum(self.lengths, 1)
        size, letters, capitals, tails, function, ends = ragged_sum(self.rows[:, 1:7], self.lengths).T
        order = np.lexsort((self.rows[:, 0], self.doc))
        code, doc = self.rows[order, 0], self.doc[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        variety = np.bincount(doc[fresh], minlength=len(n)) / n
        again = np.bincount(self.doc[self.again], minlength=len(n)) / n
        echo = np.bincount(self.doc[self.echo], minlength=len(n)) / n
        bare = np.bincount(self.doc[self.rows[:, 8] > 0], minlength=len(n)) / n
        length, some = size / n, self.lengths > 0
        long = self.lengths >= 30
        vote = lambda good, bad: np.where(good & some, GOOD, np.where(bad | ~some, BAD, 0))
        share = letters / np.maximum(size, 1)
        loud = capitals / np.maximum(letters, 1)
        return np.column_stack([
            vote(tails / n < 0.03, tails / n > 0.2), vote(loud < 0.2, loud > 0.5), vote(again < 0.03, again > 0.2),
            vote(variety > 0.4, long & (variety < 0.2)), vote(share > 0.88, share < 0.75), vote((length > 2.5) & (length < 12), length > 20),
            vote(function / n > 0.08, long & (function / n < 0.02)), vote(long & (ends / n > 0.02) & (ends / n < 0.4), long & ((ends / n < 0.004) | (ends / n > 0.6))),
            vote(bare < 0.05, bare > 0.15), vote(echo < 0.05, echo > 0.2)])

    def weighed(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each document's bins, divided by its words."""
        own = weights[self.rows[:, 7]] + weights[BINS] * self.again + weights[BINS + 1] * self.echo
        return ragged_sum(own, self.lengths) / np.maximum(self.lengths, 1)

    def shares(self) -> np.ndarray:
        """Share of each bin among a document's words; the last columns are those of repeats at distance 1 and 2."""
        out = np.zeros((len(self.lengths), BINS + 2), np.float32)
        np.add.at(out, (self.doc, self.rows[:, 7]), 1)
        np.add.at(out[:, BINS], self.doc[self.again], 1)
        np.add.at(out[:, BINS + 1], self.doc[self.echo], 1)
        return out / np.maximum(self.lengths, 1).astype(np.float32)[:, None]


def vote_batches(batches, shares: bool):
    memory = Memory(describe, REMEMBERED)
    for _, texts in text_slices(batches, most=SLICE_CHARS):
        own = Pieces(memory, texts)
        pattern = pa.array((own.votes() * 3 ** np.arange(len(LABELLERS))).sum(axis=1), pa.int64())
        if shares:
            rows = own.shares()
            bins = [np.flatnonzero(x).astype(np.uint16) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [pattern, pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([x[b].tobytes() for x, b in zip(rows, bins)], pa.binary())],
                ["pattern", "bins", "shares"])
        else:
            yield pa.RecordBatch.from_arrays([pattern], ["pattern"])


def posteriors(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Chance that a document is good, by pattern: EM over independent labellers, begun from their votes against it."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    against = (votes == BAD).sum(axis=1)
    good = np.where(against == 0, 0.95, np.where(against == 1, 0.6, 0.05))
    for _ in range(rounds):
        logs = []
        for belief in (good, 1 - good):
            own = n * belief
            table = np.stack([(own[:, None] * (votes == v)).sum(axis=0) + 0.5 for v in (GOOD, BAD)])
            table = np.vstack([np.ones(votes.shape[1]), table / table.sum(axis=0)])  # no vote says nothing
            chance = np.log(table)[votes, np.arange(votes.shape[1])].sum(axis=1)
            logs.append(chance + np.log(own.sum() + 1))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns.tolist(), good.tolist()))


def train(x: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the columns, the last of which is a constant 1: logistic regression by accelerated gradient steps, both classes weighed alike."""
    mass = np.where(good >= 0.5, 0.5 / max((good >= 0.5).sum(), 1), 0.5 / max((good < 0.5).sum(), 1)).astype(np.float32)
    weights = np.zeros(x.shape[1], np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds * 5 + 1):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (mass * (chance - good)) + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float64)


def learn(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights, from the votes on all documents and the words of a sample."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = texts.select("text").mapInArrow(lambda b: vote_batches(b, False), "pattern long").groupBy("pattern").count()
    counts = {r.pattern: r["count"] for r in counted.collect()}
    if not counts:
        return np.zeros(BINS + 3)
    chance = posteriors(counts)
    drawn = hash_sample(texts, sample).select("text").mapInArrow(
        lambda b: vote_batches(b, True), "pattern long, bins binary, shares binary").collect()  # a document has few of the bins
    shares = np.zeros((len(drawn), BINS + 3), np.float32)
    shares[:, -1] = 1
    for row, r in zip(shares, drawn):
        row[np.frombuffer(r.bins, np.uint16)] = np.frombuffer(r.shares, np.float32)
    return train(shares, np.array([chance[r.pattern] for r in drawn], np.float32))


def score_batches(batches, weights: np.ndarray, column: str):
    memory = Memory(describe, REMEMBERED)
    for part, texts in text_slices(batches, column, SLICE_CHARS):
        own = Pieces(memory, texts)
        score = 1 / (1 + np.exp(-np.clip(own.weighed(weights) + weights[-1], -500, 500)))
        score = np.where(own.lengths > 0, score, 0.0)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])


def scored(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and accepted of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(lambda b: score_batches(b, weights.value, "text"), "doc_id long, text string, score double")
    return found.select("doc_id", "score", (F.col("score") >= 0.5).alias("accepted"))


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of the documents that are not rejected, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may repeat or clash
    text = f"c{[c.lower() for c in docs.columns].index('text')}"
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", score double"
    kept = rows.mapInArrow(lambda b: score_batches(b, weights.value, text), schema).where("score >= 0.5").drop("score")
    return kept.toDF(*docs.columns)
