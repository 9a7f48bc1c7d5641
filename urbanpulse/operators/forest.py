"""Isolation forest over long feature tables, one forest per group.

Training needs at most 256 rows per tree. They are drawn inside the scan: a hash of the row tells how many trees it is
passed over before the first it is offered to, so in a large group nearly all rows cost one hash, and the exchange holds the samples
and not the data. Of the rows a tree is offered, those with the smallest MD5 of seed, tree and row are taken. Splits
are drawn by MD5 of seed, tree and node, so any engine grows the same trees. Each (group, block of trees) is built in its own
task. Scoring leaves rows where they are while the model is small, and else splits a group of any size over blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.fixed import FOREST_SAMPLE, FOREST_SEED, FOREST_THRESHOLD, FOREST_TREES
from urbanpulse.session import BROADCAST_BYTES, beside, path_bytes, written

BLOCK_ROWS = 20_000
EULER = 0.5772156649015329
TREE_BLOCK = 25
BLOCK = ("tree_block int, trees int, sample bigint, feature array<int>, cut array<double>, `left` array<int>, "
         "`right` array<int>, depth array<double>")


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def offered_trees(row_id: str, share: Column, trees: int, seed: int) -> Column:
    """The trees a row is offered to, each with probability `share` and independently: skips between them are geometric."""
    def skip(step: Column) -> Column:
        u = hash_share(F.col(row_id), step, F.lit(seed))
        return F.when(share >= 1, 0).otherwise(F.floor(F.log(1 - u) / F.log(1 - F.least(share, F.lit(0.999999))))).cast("bigint")

    first = skip(F.lit(0))
    state = F.struct(first.alias("t"), F.array(first).alias("ts"))

    def step(s: Column, k: Column) -> Column:
        t = s["t"] + 1 + skip(k)
        return F.struct(t.alias("t"), F.when(t < trees, F.concat(s["ts"], F.array(t))).otherwise(s["ts"]).alias("ts"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(trees - 1)) if trees > 1 else F.array().cast("array<int>"), state, step)["ts"]
    return F.when(first < trees, walked)


def draw_samples(rows: DataFrame, group: Sequence[str], row_id: str, trees: int = FOREST_TREES,
                 sample: int = FOREST_SAMPLE, seed: int = FOREST_SEED) -> DataFrame:
    """Up to `sample` rows per group and tree: a tree is offered about sample + 8 sqrt(sample) rows, and takes those with the smallest MD5."""
    group = list(group)
    size = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(sample + 8 * math.sqrt(sample))) / F.col("_n")
    offered = beside(rows, size, group).withColumn("tree", F.explode(offered_trees(row_id, share, trees, seed))).drop("_n")
    offered = offered.withColumn("tree", F.col("tree").cast("int"))
    name = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("tree").cast("string"), F.col(row_id).cast("string")).cast("binary"))
    rank = F.row_number().over(W.partitionBy(*group, "tree").orderBy(name, row_id))
    return offered.withColumn("_k", rank).where(F.col("_k") <= sample).drop("_k")


def node_draw(seed: int, tree: int, node: int, kind: str) -> float:
    """A number between 0 and 1 for a node; nodes are numbered as in a heap, the root is 1."""
    return (int(hashlib.md5(f"{seed}:{tree}:{node}:{kind}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def _grow(x: np.ndarray, tree: np.ndarray, numbers: Sequence[int], seed: int) -> dict[str, np.ndarray]:
    """Isolation trees in shared arrays, all trees growing level by level.

    Node t is the root of the t-th tree; a leaf has feature -1 and its expected depth.
    """
    trees = len(numbers)
    size = np.bincount(tree, minlength=trees)
    limit = np.ceil(np.log2(np.maximum(size, 2)))
    node, owner, heap = tree.copy(), np.arange(trees), [1] * trees
    first, level, parts = 0, 0, []
    while len(owner):
        here, width = node - first, len(owner)
        count = np.bincount(here, minlength=width)
        by_node = x[np.argsort(here, kind="stable")]
        start = np.cumsum(count) - count
        low, high = np.minimum.reduceat(by_node, start), np.maximum.reduceat(by_node, start)
        varies = high > low
        split = varies.any(axis=1) & (count > 1) & (level < limit[owner])
        # the k-th varying feature, k drawn evenly, and an even draw inside its span
        drawn = [[node_draw(seed, int(numbers[t]), h, kind) for t, h in zip(owner.tolist(), heap)] for kind in ("feature", "cut")]
        k = np.floor(np.array(drawn[0]) * varies.sum(axis=1)) + 1
        feature = np.argmax(np.cumsum(varies, axis=1) >= k[:, None], axis=1)
        lo, hi = low[np.arange(width), feature], high[np.arange(width), feature]
        with np.errstate(invalid="ignore"):
            cut = np.where(split, lo + np.array(drawn[1]) * (hi - lo), 0.0)
        cut = np.where(split & (cut >= hi), np.nextafter(hi, -np.inf), cut)
        child = first + width + 2 * (np.cumsum(split) - 1)
        parts.append((np.where(split, feature, -1), cut, np.where(split, child, -1), np.where(split, child + 1, -1),
                      np.where(split, 0.0, level + average_path(count))))
        moving = split[here]
        x, here = x[moving], here[moving]
        below = x[np.arange(len(x)), feature[here]] <= cut[here]
        node = np.where(below, child[here], child[here] + 1)
        heap = [2 * h + side for h, s in zip(heap, split.tolist()) if s for side in (0, 1)]
        first, level, owner = first + width, level + 1, np.repeat(owner[split], 2)
    return dict(zip(("feature", "cut", "left", "right", "depth"), (np.concatenate(p) for p in zip(*parts))))


def _build(group: Sequence[str], features: Sequence[str], row_id: str, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", row_id], kind="stable")
        numbers, tree = np.unique(pdf["tree"].to_numpy(), return_inverse=True)
        block = int(pdf["tree_block"].iloc[0])
        arrays = _grow(pdf[list(features)].to_numpy(dtype=float), tree, numbers.tolist(), seed)
        out = {g: [pdf[g].iloc[0]] for g in group}
        out |= {"tree_block": [block], "trees": [len(numbers)], "sample": [int(np.bincount(tree).max())]}
        return pd.DataFrame(out | {name: [values] for name, values in arrays.items()})

    return build


def _group_schema(rows: DataFrame, group: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)


def grow_forest(rows: DataFrame, group: Sequence[str], features: Sequence[str], row_id: str,
                trees: int = FOREST_TREES, sample: int = FOREST_SAMPLE, seed: int = FOREST_SEED) -> DataFrame:
    """One row per group and block of trees; a task sees at most TREE_BLOCK samples."""
    drawn = draw_samples(rows.select(*group, row_id, *features), group, row_id, trees, sample, seed)
    blocked = drawn.withColumn("tree_block", F.floor(F.col("tree") / TREE_BLOCK).cast("int"))
    return blocked.groupBy(*group, "tree_block").applyInPandas(
        _build(group, features, row_id, seed), f"{_group_schema(rows, group)}, {BLOCK}")


def _total_depth(x: np.ndarray, block) -> np.ndarray:
    """Summed expected depth of each row over a block of trees, all stepping down together."""
    feature, cut, left, right, depth = (np.asarray(a) for a in (block.feature, block.cut, block.left, block.right, block.depth))
    at = np.tile(np.arange(block.trees), (len(x), 1))
    every = np.arange(len(x))[:, None]
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return depth[at].sum(axis=1)
        down = np.where(x[every, np.where(inner, f, 0)] <= cut[at], left[at], right[at])
        at = np.where(inner, down, at)


def _raw_score(x: np.ndarray, forest: pd.DataFrame) -> np.ndarray:
    """Anomaly score in (0, 1). Blocks are added in a fixed order, so sums do not depend on arrival."""
    ordered = forest.sort_values("tree_block")
    mean = sum(_total_depth(x, block) for block in ordered.itertuples()) / int(ordered["trees"].sum())
    scale = float(average_path(int(ordered["sample"].max())))
    return np.exp2(-mean / scale) if scale > 0 else np.full(len(x), 0.5)


def _score_blocks(names: Sequence[str], features: Sequence[str]):
    def score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out = rows[list(names)].copy()
        known = len(rows) > 0 and len(forest) > 0
        x = rows[list(features)].to_numpy(dtype=float)
        out["raw_score"] = _raw_score(x, forest) if known else np.full(len(rows), np.nan)
        return out

    return score


def _score_in_place(forests, group: Sequence[str], names: Sequence[str], features: Sequence[str]):
    def score(batches):
        known = forests.value
        for rows in batches:
            raw = np.full(len(rows), np.nan)
            x = rows[list(features)].to_numpy(dtype=float)
            for key, at in rows.groupby(list(group), dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                if key in known:
                    raw[at] = _raw_score(x[at], known[key])
            out = rows[list(names)].copy()
            out["raw_score"] = raw
            yield out

    return score


def score_forest(rows: DataFrame, forest: DataFrame, group: Sequence[str], features: Sequence[str],
                 row_id: str, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds if_score (lower is more anomalous), if_label (-1 or 1) and anomaly.

    A group's forest has a fixed size, so few groups make a small model: it is broadcast and
    rows are scored where they are. A larger model is joined instead, to blocks of rows that
    `row_id` (which identifies a row of its group) spreads over the cluster.
    """
    group, spark = list(group), rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", raw_score double"
    path = written(forest)
    forest = spark.read.schema(forest.schema).parquet(path)
    if path_bytes(spark, path) <= broadcast_bytes:
        model = {k if isinstance(k, tuple) else (k,): part for k, part in forest.toPandas().groupby(group, dropna=False)}
        scored = rows.mapInPandas(
            _score_in_place(spark.sparkContext.broadcast(model), group, rows.columns, features), schema)
    else:
        size = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        blocks = F.ceil(F.col("_n") / F.lit(float(block_rows))).cast("bigint")
        placed = beside(rows, size, group).withColumn("_block", F.pmod(F.xxhash64(F.col(row_id)), blocks)).drop("_n")
        copies = beside(forest, size, group).withColumn(
            "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("_n")
        keys = [*group, "_block"]
        scored = placed.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(
            _score_blocks(rows.columns, features), schema)
    # a score above the threshold is an anomaly; the decision value is its distance below it
    decision = F.lit(FOREST_THRESHOLD) - F.col("raw_score")
    return scored.withColumn("if_score", decision).withColumn(
        "if_label", F.when(F.col("if_score") < 0, -1).otherwise(1)).withColumn(
        "anomaly", F.col("if_label") == -1).drop("raw_score")


def detect(rows: DataFrame, group: Sequence[str], features: Sequence[str], row_id: str,
           trees: int = FOREST_TREES, sample: int = FOREST_SAMPLE, seed: int = FOREST_SEED) -> DataFrame:
    """Fit and score on the same rows. Features must not be null (see `anomaly.standardise`)."""
    forest = grow_forest(rows, group, features, row_id, trees, sample, seed)
    return score_forest(rows, forest, group, features, row_id)
