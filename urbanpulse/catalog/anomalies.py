"""Hourly features, imputation, forests and the tables made from anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import EV, JANUARY, PERIOD_TEST, clock, events, periods_sql, r6, table
from urbanpulse.operators import anomaly
from urbanpulse.operators.periods import with_periods
from urbanpulse.operators.quantiles import exact_quantiles
from urbanpulse.plans.reports import anomaly_report
from urbanpulse.session import materialise

register = Register()

GROUP = ("period", "mode")
FEATURES = ("load", "delay", "headway")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Three features per window, event type and hour; the delay is missing where no value is below 20.

    Written once, since imputation, scaling and detection each read it.
    """
    placed = with_periods(events(spark, sf), F.col("ts"), JANUARY)
    return materialise(placed.groupBy(
        "period", F.col("event_type").alias("mode"), F.date_trunc("hour", "ts").alias("hour")
    ).agg(
        F.sum("value").alias("load"), F.avg(F.when(F.col("value") < 20, F.col("value"))).alias("delay"),
        F.avg("k").alias("headway")))


HOURLY = f"""WITH {EV}, {periods_sql(JANUARY)}, hourly AS (SELECT period, event_type AS mode, date_trunc('hour', ts) AS hour,
  sum(value) AS load, avg(CASE WHEN value < 20 THEN value END) AS delay, avg(k) AS headway
  FROM ev JOIN periods ON {PERIOD_TEST} GROUP BY ALL)"""
ZSCORED = f"""{HOURLY}, med AS (SELECT period, mode, median(load) AS ml, median(delay) AS md, median(headway) AS mh FROM hourly GROUP BY ALL),
filled AS (SELECT period, mode, hour, load, coalesce(delay, md) AS delay, headway FROM hourly JOIN med USING (period, mode)),
z AS (SELECT period, mode, hour, (load - avg(load) OVER w) / stddev_pop(load) OVER w AS load_z,
  (delay - avg(delay) OVER w) / stddev_pop(delay) OVER w AS delay_z, (headway - avg(headway) OVER w) / stddev_pop(headway) OVER w AS headway_z
  FROM filled WINDOW w AS (PARTITION BY period, mode)),
flagged AS (SELECT *, -load_z AS if_score, load_z > 1.5 AS anomaly, delay_z > 0.5 AS injected FROM z)"""


def scored_by_load(spark: SparkSession, sf: str) -> DataFrame:
    """Flags by a plain rule on the z-score, so that the tables below can be checked exactly."""
    z = anomaly.standardise(hourly(spark, sf), GROUP, FEATURES)
    return z.select(*GROUP, "hour", *FEATURES, (-F.col("load_z")).alias("if_score"), (F.col("load_z") > 1.5).alias("anomaly"),
                    (F.col("delay_z") > 0.5).alias("injected")).withColumn("if_label", F.when(F.col("anomaly"), -1).otherwise(1))


@register(f"""{ZSCORED} SELECT period, mode, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(load_z, 6) AS load_z,
  round(delay_z, 6) AS delay_z, round(headway_z, 6) AS headway_z FROM z""")
def zscore_impute(spark: SparkSession, sf: str) -> DataFrame:
    z = anomaly.standardise(hourly(spark, sf), GROUP, FEATURES)
    return z.select(*GROUP, clock(F.col("hour"), "hour"), *[r6(F.col(f"{c}_z"), f"{c}_z") for c in FEATURES])


@register("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.01), 6) AS p01,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def large_group_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_quantiles(events(spark, sf), ["event_type"], "value", {"p01": 0.01, "median": 0.5, "p99": 0.99})
    return out.select("event_type", "n", *[r6(F.col(c), c) for c in ("p01", "median", "p99")])


@register("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY ALL""")
def price_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                          {"median": 0.5, "p95": 0.95})
    return out.select("l_returnflag", "l_linestatus", "n", r6(F.col("median"), "median"), r6(F.col("p95"), "p95"))


@register(f"""{ZSCORED} SELECT period, mode, CAST(count(*) AS BIGINT) AS hours, CAST(count(*) FILTER (anomaly) AS BIGINT) AS anomalies,
  round(count(*) FILTER (anomaly) * 100.0 / count(*), 2) AS anomaly_rate_pct, round(avg(if_score), 4) + 0.0 AS score_mean,
  round(stddev_samp(if_score), 4) AS score_std, round(min(if_score), 4) AS score_min,
  round(coalesce(count(*) FILTER (anomaly AND injected)::DOUBLE / nullif(count(*) FILTER (anomaly), 0), 0), 2) AS precision
FROM flagged GROUP BY ALL""")
def anomaly_summary(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.anomaly_summary(scored_by_load(spark, sf))


@register(f"""{ZSCORED}, cells AS (SELECT mode, isodow(hour) - 1 AS weekday, extract(hour FROM hour) AS h, avg(CAST(anomaly AS DOUBLE)) AS rate
  FROM flagged GROUP BY ALL), frame AS (SELECT mode, CAST(d AS INTEGER) AS weekday FROM (SELECT DISTINCT mode FROM flagged), range(7) AS r(d))
SELECT mode, weekday, {", ".join(f"round(coalesce(max(rate) FILTER (h = {h}), 0), 6) AS h{h:02d}" for h in range(24))}
FROM frame LEFT JOIN cells USING (mode, weekday) GROUP BY mode, weekday""")
def anomaly_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.anomaly_heatmap(scored_by_load(spark, sf))
    return out.select("mode", "weekday", *[r6(F.col(f"h{h:02d}"), f"h{h:02d}") for h in range(24)])


@register(f"{ZSCORED} SELECT mode, round(max(if_score) FILTER (anomaly), 6) AS boundary FROM flagged GROUP BY mode")
def score_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.score_boundary(scored_by_load(spark, sf)).select("mode", r6(F.col("boundary"), "boundary"))


@register("""WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
SELECT event_type, CAST(least(floor((value - lo) / (hi - lo) * 32), 31) + 1 AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n
FROM events JOIN s USING (event_type) GROUP BY ALL""")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.score_histogram(events(spark, sf), ("event_type",), "value")


@register(f"""WITH {EV}, long AS (SELECT event_type, k < 10 AS anomaly, 'value' AS feature, value AS v FROM ev
  UNION ALL SELECT event_type, k < 10, 'user', user_id FROM ev),
s AS (SELECT event_type, feature, anomaly, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-9::DOUBLE) AS v FROM long WINDOW w AS (PARTITION BY event_type, feature)),
q AS (SELECT event_type, feature, anomaly, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT event_type, feature, anomaly, CAST(any_value(n) AS BIGINT) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  CAST(count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM s JOIN q USING (event_type, feature, anomaly) GROUP BY ALL""")
def box_stats_events(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes over all events of a type, groups that grow with the data."""
    rows = events(spark, sf).select("event_type", (F.col("k") < 10).alias("anomaly"), "value", F.col("user_id").alias("user"))
    out = anomaly.box_stats(rows, ("value", "user"), ("event_type",))
    return out.select("event_type", "feature", "anomaly", "n", *[r6(F.col(c), c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")


@register(f"""{ZSCORED}, long AS (SELECT mode, anomaly, 'load' AS feature, hourly.load AS v FROM hourly JOIN flagged USING (period, mode, hour)
  UNION ALL SELECT mode, anomaly, 'headway', hourly.headway FROM hourly JOIN flagged USING (period, mode, hour)),
s AS (SELECT mode, feature, anomaly, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-9::DOUBLE) AS v FROM long WINDOW w AS (PARTITION BY mode, feature)),
q AS (SELECT mode, feature, anomaly, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT mode, feature, anomaly, CAST(any_value(n) AS BIGINT) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  CAST(count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM s JOIN q USING (mode, feature, anomaly) GROUP BY ALL""")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.box_stats(scored_by_load(spark, sf), ("load", "headway"))
    return out.select("mode", "feature", "anomaly", "n", *[r6(F.col(c), c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")


@register(f"""{ZSCORED} SELECT period, mode, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, CAST(row_number() OVER w - 1 AS INTEGER) AS hour_offset,
  round(avg(CAST(anomaly AS DOUBLE)) OVER (PARTITION BY period, mode ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS density
FROM flagged WINDOW w AS (PARTITION BY period, mode ORDER BY hour)""")
def rolling_density(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.rolling_density(scored_by_load(spark, sf))
    return out.select(*GROUP, clock(F.col("hour"), "hour"), "hour_offset", r6(F.col("density"), "density"))


def forest_sql(points: str, levels: int = 8, trees: int = 200, sample: int = 256, seed: int = 42) -> str:
    """CTEs from `pts(g, id, x)` to `scored(g, id, if_score)`: isolation trees grown level by level, draws by MD5."""
    u = "(('0x' || substr(md5('{seed}:' || t || ':' || node || ':{kind}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
    path = "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END"
    sql = [points, f"""drawn AS MATERIALIZED (SELECT g, t, id, x FROM (SELECT *, row_number() OVER (PARTITION BY g, t ORDER BY md5('{seed}:' || t || ':' || id), id) AS k
  FROM pts, range({trees}) r(t)) WHERE k <= {sample})""",
           "sizes AS MATERIALIZED (SELECT g, t, count(*) AS size, ceil(log2(greatest(count(*), 2))) AS high FROM drawn GROUP BY ALL)",
           "l0 AS MATERIALIZED (SELECT g, t, 1::BIGINT AS node, id, x FROM drawn)"]
    for d in range(levels + 1):
        sql.append(f"""n{d} AS MATERIALIZED (SELECT g, t, node, n, nv > 0 AND n > 1 AND {d} < high AS split, f, lo + cut * (hi - lo) AS cut FROM (
  SELECT g, t, node, n, nv, high, cut, vf[CAST(floor(pick * nv) AS BIGINT) + 1] AS f, lows[vf[CAST(floor(pick * nv) AS BIGINT) + 1]] AS lo,
    highs[vf[CAST(floor(pick * nv) AS BIGINT) + 1]] AS hi FROM (
    SELECT *, len(vf) AS nv, {u.format(seed=seed, kind="feature")} AS pick, {u.format(seed=seed, kind="cut")} AS cut FROM (
      SELECT g, t, node, max(n) AS n, list(lo ORDER BY j) AS lows, list(hi ORDER BY j) AS highs, coalesce(list(j ORDER BY j) FILTER (hi > lo), []) AS vf FROM (
        SELECT g, t, node, j, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT g, t, node, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM l{d}) GROUP BY ALL)
      GROUP BY ALL) JOIN sizes USING (g, t))))""")
        sql.append(f"""l{d + 1} AS MATERIALIZED (SELECT g, t, 2 * node + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END AS node, id, x FROM l{d} JOIN n{d} USING (g, t, node) WHERE split)""")
    sql.append("w0 AS (SELECT g, t, 1::BIGINT AS node, id, x FROM pts JOIN sizes USING (g))")
    leaves = []
    for d in range(levels + 1):
        leaves.append(f"SELECT g, id, {d} + {path.format(n='n')} AS depth FROM w{d} JOIN n{d} USING (g, t, node) WHERE NOT split")
        sql.append(f"w{d + 1} AS MATERIALIZED (SELECT g, t, 2 * node + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END AS node, id, x FROM w{d} JOIN n{d} USING (g, t, node) WHERE split)")
    sql.append(f"""scored AS (SELECT g, id, 0.5 - pow(2, -avg(depth) / any_value({path.format(n='most')})) AS if_score
  FROM ({" UNION ALL ".join(leaves)}) JOIN (SELECT g, max(size) AS most FROM sizes GROUP BY g) USING (g) GROUP BY g, id)""")
    return ",\n".join(sql)


HOURLY_FOREST = f"""{ZSCORED}, {forest_sql("pts AS MATERIALIZED (SELECT period || '/' || mode AS g, strftime(hour, '%Y-%m-%d %H:%M:%S') AS id, [round(load_z, 9), round(delay_z, 9), round(headway_z, 9)] AS x FROM z)")},
found AS (SELECT period, mode, hour, if_score FROM z JOIN scored ON g = period || '/' || mode AND id = strftime(hour, '%Y-%m-%d %H:%M:%S'))"""


@register(f"""{HOURLY_FOREST} SELECT period, mode, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(if_score, 6) AS if_score,
  CASE WHEN if_score < 0 THEN -1 ELSE 1 END AS if_label, if_score < 0 AS anomaly FROM found""")
def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Detection over all windows and modes of the hourly features."""
    out = anomaly.detect_anomalies(hourly(spark, sf), GROUP, FEATURES, "hour")
    return out.select(*GROUP, clock(F.col("hour"), "hour"), r6(F.col("if_score"), "if_score"), "if_label", "anomaly")


@register(f"""WITH dims AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings),
z AS (SELECT label, vec_id, j, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0.0 END AS v FROM dims WINDOW w AS (PARTITION BY label, j)),
{forest_sql("pts AS MATERIALIZED (SELECT label AS g, vec_id AS id, list(round(v, 9) ORDER BY j) AS x FROM z GROUP BY label, vec_id)")}
SELECT g AS label, id AS vec_id, round(if_score, 6) AS if_score, CASE WHEN if_score < 0 THEN -1 ELSE 1 END AS if_label FROM scored""")
def iforest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Forests over all dimensions of the vectors of each label, a table whose groups grow with the data."""
    vectors = table(spark, sf, "embeddings")
    names = [f"d{i}" for i in range(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)]
    rows = vectors.select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(names)])
    out = anomaly.detect_anomalies(rows, ("label",), names, "vec_id")
    return out.select("label", "vec_id", r6(F.col("if_score"), "if_score"), "if_label")


@register(f"""{HOURLY_FOREST} SELECT period, mode, CAST(count(*) AS BIGINT) AS hours, CAST(count(*) FILTER (if_score < 0) AS BIGINT) AS anomalies,
  round(count(*) FILTER (if_score < 0) * 100.0 / count(*), 2) AS anomaly_rate_pct, round(avg(if_score), 4) + 0.0 AS score_mean,
  round(stddev_samp(if_score), 4) AS score_std, round(min(if_score), 4) AS score_min, CAST(NULL AS DOUBLE) AS precision FROM found GROUP BY ALL""")
def detection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly_report(hourly(spark, sf), FEATURES)["summary"]


QUERIES, ORACLES = register.queries, register.oracles
