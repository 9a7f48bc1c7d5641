"""The training-data pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. The
first four return the columns of `documents`, with fewer rows or other texts; the last returns the tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.llm import decontaminate, jaccard, privacy, quality, tokens
from urbanpulse.session import checkpoint_dir

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose doc_id is in `chosen`; null matches null."""
    ids = chosen.select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_chosen"]), "left_semi")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and all documents without words.

    Rows that repeat a doc_id all stay if it stays. Groups of rows without a doc_id stay whole.
    """
    joined = jaccard.join_documents(docs, NEAR_WORDS, NEAR_PERCENT)
    return keep_rows(docs, joined.where("doc_id = component_id OR doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, benchmark)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts."""
    return privacy.replaced(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return tokens.digests(tokens.round_trip(docs))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("surrogates", replace_personal_data),
    ("tokens", to_tokens),
]

# Learned weights, keyed digests and merge rules are not expressible in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
