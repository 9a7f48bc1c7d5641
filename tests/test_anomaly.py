"""Imputation, isolation forest and feed-health rules."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanpulse.operators import anomaly, forest, health

T0 = datetime(2026, 1, 31)


def features(spark, n=192, groups=("a",)):
    rng = np.random.default_rng(7)
    rows = []
    for g in groups:
        x = rng.normal(size=(n, 2))
        x[5] = (12.0, -12.0)
        rows += [("p", g, T0 + timedelta(hours=i), float(x[i, 0]), float(x[i, 1]), 3.0, i == 5) for i in range(n)]
    return spark.createDataFrame(rows, "period string, mode string, hour timestamp, f1 double, f2 double, f3 double, injected boolean")


def test_outlier_has_lowest_score_and_order_does_not_matter(spark):
    df = features(spark)
    out = anomaly.detect_anomalies(df, ("period", "mode"), ("f1", "f2", "f3"), "hour", trees=60)
    rows = {r["hour"]: r["if_score"] for r in out.collect()}
    assert len(rows) == 192 and min(rows, key=rows.get) == T0 + timedelta(hours=5)
    assert out.where("anomaly").count() < 96 and out.where("if_label = -1 and if_score >= 0").count() == 0
    again = anomaly.detect_anomalies(df.repartition(7), ("period", "mode"), ("f1", "f2", "f3"), "hour", trees=60)
    assert {r["hour"]: r["if_score"] for r in again.collect()} == pytest.approx(rows, abs=1e-12)


def test_samples_are_bounded_and_blocks_agree(spark):
    big = spark.range(3000).select(F.lit("g").alias("g"), F.col("id"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"))
    drawn = forest.draw_samples(big, ["g"], "id", trees=12, sample=64)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 64 and min(sizes) >= 60
    trees = forest.grow_forest(big, ["g"], ["x", "y"], "id", trees=12, sample=64)
    whole = forest.score_forest(big, trees, ["g"], ["x", "y"], "id")
    split = forest.score_forest(big, trees, ["g"], ["x", "y"], "id", block_rows=100, broadcast_bytes=0)
    both = whole.join(split.select("id", F.col("if_score").alias("other")), "id")
    assert both.count() == 3000 and both.where(F.abs(F.col("if_score") - F.col("other")) > 1e-12).count() == 0


def test_trees_of_a_large_group_draw_alike(spark):
    """Every row is as likely for every tree, and trees do not share their draws."""
    big = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id"))
    drawn = forest.draw_samples(big, ["g"], "id", trees=40, sample=64).persist()
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert sorted(sizes) == list(range(40)) and max(sizes.values()) <= 64 and min(sizes.values()) >= 60
    n = drawn.count()
    assert 0.85 * n < drawn.select("id").distinct().count() <= n  # 40 trees of 64 rows hit few rows twice
    assert abs(drawn.agg(F.avg("id")).first()[0] - 10_000) < 500
    offered = big.select(F.explode(forest.offered_trees("id", F.lit(0.01), 40, 7)).alias("t")).groupBy("t").count().collect()
    assert len(offered) == 40 and all(130 < r["count"] < 280 for r in offered)


def test_small_groups_give_all_rows_to_all_trees(spark):
    small = spark.range(30).select(F.lit("g").alias("g"), F.col("id"))
    assert forest.draw_samples(small, ["g"], "id", trees=7, sample=64).count() == 210
    assert forest.draw_samples(small, ["g"], "id", trees=1, sample=64).count() == 30


def test_average_path():
    assert list(forest.average_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert forest.average_path(256) == pytest.approx(10.2445, abs=1e-3)


def test_median_and_constant_feature(spark):
    df = spark.createDataFrame([("g", 1.0, 4.0), ("g", 3.0, 4.0), ("g", None, 4.0), ("g", 8.0, 4.0)], "g string, a double, b double")
    out = sorted(r["a_z"] for r in anomaly.standardise(df, ["g"], ["a", "b"]).collect())
    x = np.array([1, 3, 3, 8.0])
    assert out == pytest.approx(sorted((x - x.mean()) / x.std()))
    none = df.withColumns({"g": F.lit(None).cast("string"), "a": F.lit(None).cast("double")})
    assert [r["a_z"] for r in anomaly.standardise(none, ["g"], ["a", "b"]).collect()] == [None] * 4
    assert {r["b_z"] for r in anomaly.standardise(df, ["g"], ["a", "b"]).collect()} == {0.0}


def test_precision(spark):
    df = spark.createDataFrame([(True, True), (True, False), (True, None), (False, True)], "anomaly boolean, injected boolean")
    assert df.agg(anomaly.precision(F.col("anomaly"), F.col("injected"))).first()[0] == 0.33
    assert df.where("not anomaly").agg(anomaly.precision(F.col("anomaly"), F.col("injected"))).first()[0] == 0.0


def test_rolling_density_and_histogram_edges(spark):
    df = spark.createDataFrame([("p", "m", T0 + timedelta(hours=i), i == 0, float(i)) for i in range(33)], "period string, mode string, hour timestamp, anomaly boolean, if_score double")
    out = anomaly.rolling_density(df).orderBy("hour").collect()
    assert out[0]["density"] == 1.0 and out[23]["density"] == pytest.approx(1 / 24) and out[24]["density"] == 0.0
    bins = {r["bin"]: r["n"] for r in anomaly.score_histogram(df).collect()}
    assert max(bins) == 32 and bins[32] == 2 and sum(bins.values()) == 33
    heat = anomaly.anomaly_heatmap(df)
    assert heat.count() == 7 and heat.where("weekday = 0").first()["h00"] == 0.0


def arrivals(spark, seconds, source="s"):
    t = np.cumsum([0, *seconds])
    return spark.createDataFrame([(source, T0 + timedelta(seconds=int(x))) for x in t], "source string, last_modified timestamp")


def test_gaps(spark):
    out = health.gap_stats(arrivals(spark, [60, 60, 700]), F.lit(60)).first()
    assert (out["median_gap_s"], out["n_outage_gaps_gt10x"], out["pct_within_2x_nominal"]) == (60.0, 1, 66.7)
    single = health.gap_stats(arrivals(spark, []), F.lit(60)).first()
    assert single["n_files"] == 1 and single["status"] == "insufficient data" and single["mean_gap_s"] is None


def test_gaps_across_slots_and_ties(spark):
    rng = np.random.default_rng(2)
    steps = [int(s) for s in rng.integers(0, 9000, 400)]
    rows = arrivals(spark, steps)
    got = {r["gap_s"]: r["n"] for r in health.arrival_gaps(rows).collect()}
    values, counts = np.unique(steps, return_counts=True)
    assert got == {float(v): int(c) for v, c in zip(values, counts)}


def test_latency_band(spark):
    rows = spark.createDataFrame([(T0, e) for e in (5, 0, -3599, -3600)], "at timestamp, shift int")
    epoch = F.unix_seconds("at") + F.col("shift")
    assert sorted(r["latency_s"] for r in health.latencies(rows, epoch, F.col("at")).collect()) == [0.0, 3599.0]
    assert health.latencies(rows, F.lit(0), F.col("at")).count() == 0


def test_files_per_cycle_needs_twenty(spark):
    few = health.files_per_cycle(arrivals(spark, [60] * 18), F.lit(60)).first()["files_per_cycle"]
    many = health.files_per_cycle(arrivals(spark, [60] * 39), F.lit(60)).first()["files_per_cycle"]
    assert few is None and many == pytest.approx(6 / 5)
