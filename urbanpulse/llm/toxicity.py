"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression (operator 7).

Learning uses at most SAMPLE labelled rows outside the held-out fold, those with the smallest
hash. The lexicon are words whose share of toxic documents is too high for chance, by the log-likelihood ratio. Each
half of the sample is described with the lexicon of the other half, so that trees and calibration see what a lexicon does
on unknown texts; the documents are described with the lexicon of both. Trees are grown on four fifths of the
sample and calibrated on the rest.
Features of a document: hits, different hits and density of the lexicon, density of its surest words, hits near a second-person
word, capitals, exclamation and other punctuation, obfuscated hits (digits or signs in place of letters),
words. Features are computed by the tasks that read the texts; trees and calibration are Spark's own.

Scores lie between 0 and 1, also for null and empty texts, which have all features 0. If the
labels lack one of both classes, every score is the share of toxic labels (0.5 without labels). Rows of
`documents` that repeat are scored each; where a doc_id has several labels, each pairing counts. Null labels
and a null doc_id teach nothing. Further columns of either table are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanpulse.llm.samples import hash_sample, held_out
from urbanpulse.llm.text import Memory, ragged_sum, text_slices
from urbanpulse.session import materialise

SAMPLE = 20_000  # labelled rows
LEXICON = 1_000  # words
UNLIKELY, SURE = 14.0, 30.0  # least log-likelihood ratio of a lexicon word, and of a sure one
NEAR = 5  # words
TREES, DEPTH = 30, 3

# Second-person words of the languages at hand, and look-alike signs; fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
    "sie ihnen usted ustedes vosotros tus vuestro".split())
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ("hits", "kinds", "density", "sure", "near_second_person", "capitals", "exclamations", "punctuation", "obfuscated", "words")
NOT_WORD = re.compile(r"[\W_]+")


def plain(piece: str) -> str:
    return piece if piece.isalpha() else NOT_WORD.sub("", piece)


class PieceFeatures:
    """For each piece: lexicon word + 1 or 0, obfuscated, second person, letters, capitals, exclamation marks, other signs, sure."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        self.lexicon = {w: i + 1 for i, (w, _) in enumerate(lexicon)}
        self.sure = {w for w, ratio in lexicon if ratio >= SURE}

    def __call__(self, pieces: list[str]) -> np.ndarray:
        return np.array([self.one(p) for p in pieces], np.int64).reshape(-1, 8)

    def one(self, piece: str) -> tuple[int, ...]:
        if piece.isalpha() and piece.islower():
            return self.lexicon.get(piece, 0), 0, piece in SECOND_PERSON, len(piece), 0, 0, 0, piece in self.sure
        word = plain(piece.lower())
        hit = self.lexicon.get(word, 0)
        hidden = 0 if hit else self.lexicon.get(plain(piece.lower().translate(LOOK_ALIKE)), 0)
        letters, capitals, marks = sum(map(str.isalpha, piece)), sum(map(str.isupper, piece)), piece.count("!")
        return hit or hidden, hidden > 0, word in SECOND_PERSON, letters, capitals, marks, len(piece) - letters - marks, word in self.sure


def features(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document."""
    hit = rows[:, 0] > 0
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    at = np.flatnonzero(hit)
    spoken = np.concatenate([[0], np.cumsum(rows[:, 2])])
    low, high = np.maximum(starts[doc[at]], at - NEAR), np.minimum(ends[doc[at]], at + NEAR + 1)
    near = np.bincount(doc[at], weights=spoken[high] > spoken[low], minlength=len(lengths))
    pairs = np.unique(np.stack([doc[at], rows[at, 0]]), axis=1)[0] if len(at) else doc[:0]
    sums = ragged_sum(np.column_stack([hit, rows[:, 1], rows[:, 3:]]).astype(np.float64), lengths)
    hits, obfuscated, letters, capitals, marks, signs, sure = sums.T
    words = np.maximum(lengths, 1)
    return np.column_stack([
        hits, np.bincount(pairs, minlength=len(lengths)), hits / words, sure / words, near, capitals / np.maximum(letters, 1),
        marks / words, signs / words, obfuscated / words, np.log1p(lengths)])


def feature_batches(batches, lexicon: list[tuple[str, float]]):
    memory = Memory(PieceFeatures(lexicon))
    for part, texts in text_slices(batches):
        pieces = [t.split() for t in texts]
        lengths = np.array([len(p) for p in pieces], np.int64)
        table = features(memory([p for ps in pieces for p in ps]), lengths)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(list(table), pa.list_(pa.float64()))], ["doc_id", "features"])


def with_features(rows: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    """doc_id and the features as a vector."""
    own = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(lambda b: feature_batches(b, lexicon), "doc_id long, features array<double>").select(
        "doc_id", array_to_vector("features").alias("features"))


def toxic_words(rows: DataFrame, size: int = LEXICON) -> list[tuple[str, float]]:
    """Words that stand in too many toxic documents for chance, with the log-likelihood ratio."""
    word = F.regexp_replace(F.lower(F.col("piece")), r"[^\p{L}\p{N}]+", "")
    words = rows.select("toxic", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("piece")).select("toxic", word.alias("word"))
    both = rows.agg(F.sum("toxic").alias("all_toxic"), F.count("*").alias("all_rows"))
    k, n = F.col("k"), F.col("n")
    p, q = F.col("all_toxic") / F.col("all_rows"), k / n
    ratio = 2 * (k * F.log(q / p) + F.when(k < n, (n - k) * F.log((1 - q) / (1 - p))).otherwise(0))
    counted = words.where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).where("k > 1")
    scored = counted.crossJoin(F.broadcast(both)).where(q > p).withColumn("ratio", ratio).where(F.col("ratio") >= UNLIKELY)  # one row of totals
    return [(r.word, r.ratio) for r in scored.orderBy(F.desc("ratio"), "word").limit(size).collect()]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    told = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = hash_sample(told.where(~held_out()), sample)
    learned = materialise(rows.where("text IS NOT NULL").join(chosen, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))))
    classes = {r.toxic: r["count"] for r in learned.groupBy("toxic").count().collect()}
    table = with_features(rows, toxic_words(learned))
    share = classes.get(1, 0) / max(1, sum(classes.values())) if classes else 0.5
    scored = None
    if min(classes.get(0, 0), classes.get(1, 0)) >= 10:
        even = learned.where("part % 2 = 0")
        odd = learned.where("part % 2 = 1")
        described = with_features(even, toxic_words(odd)).union(with_features(odd, toxic_words(even)))
        labels = learned.select("doc_id", "part", F.col("toxic").cast("double").alias("label"))
        fit = materialise(described.join(labels, "doc_id").select("features", "label", "part"))
        if fit.where("part < 8").select("label").distinct().count() == 2:
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=32).fit(fit.where("part < 8"))
            raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
            steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score")
            held = fit.where("part >= 8")
            scored = raw(table)
            scored = steps.fit(raw(held)).transform(scored) if held.count() else scored.withColumn("score", F.col("raw"))
    if scored is None:
        scored = table.withColumn("score", F.lit(float(share)))
    clipped = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out().alias("held_out"), clipped.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
