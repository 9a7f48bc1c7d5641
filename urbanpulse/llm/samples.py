"""Bounded samples of rows and the fold rule of the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def draw() -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit("draw"))


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, those with the smallest hash of doc_id; only rows near the bound are sorted."""
    total = rows.count()
    share = min(1.0, 1.5 * n / max(total, 1) + 50 / max(total, 1))
    low = F.lit(int(-(2**63) + share * (2**64 - 2**11)))
    near = rows.where(draw() <= low) if share < 1 else rows
    return near.orderBy(draw(), "doc_id").limit(n)
