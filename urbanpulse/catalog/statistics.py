"""Correlation, regression and test queries over the hourly fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import (
    INDEX,
    JANUARY,
    OVERLAPPING,
    PEAK,
    clock,
    corr_sql,
    events,
    fact_sql,
    feeds,
    index_sql,
    r6,
    table,
)
from urbanpulse.fixed import INDEX_VARIANTS
from urbanpulse.functions.rounding import rounded
from urbanpulse.operators import correlate, peak
from urbanpulse.operators.minute_fact import minute_fact, weather_minutes, with_zone
from urbanpulse.plans.impact import period_fact, summary_row

register = Register()

KEY = ("period",)
WITH_INDEX = "indexed AS (SELECT *, {index} AS multimodal_activity FROM fact)"
PERIOD_INDEXED = f"{fact_sql('hour', JANUARY)}, " + WITH_INDEX.format(index=index_sql(INDEX, "PARTITION BY period"))
OVERLAP_INDEXED = f"{fact_sql('hour', OVERLAPPING)}, " + WITH_INDEX.format(index=index_sql(INDEX, "PARTITION BY period"))


def january(spark: SparkSession, sf: str) -> DataFrame:
    return period_fact(feeds(events(spark, sf)), JANUARY, "hour")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return minute_fact(feeds(events(spark, sf)), unit="hour")


def _all_correlations() -> str:
    t = {n: ("road_temperature", c) for n, c in (correlate.RESPONSES | correlate.TEMPERATURE_ONLY).items()}
    named = {f"temperature_vs_{n}": xy for n, xy in t.items()}
    for p, x in correlate.PREDICTORS.items():
        named |= {f"{p}_vs_{n}": (x, y) for n, y in correlate.RESPONSES.items()}
    rows = [f"round({corr_sql(x, y)}, 6) AS {name}" for name, (x, y) in named.items()]
    rows += [f"CAST(count(*) FILTER (road_temperature IS NOT NULL AND {c} IS NOT NULL) AS BIGINT) AS n_temperature_vs_{n}"
             for n, c in correlate.RESPONSES.items()]
    return ", ".join(rows)


def _round_correlations(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if "_vs_" in c and not c.startswith("n_") else F.col(c) for c in df.columns])


@register(f"""{OVERLAP_INDEXED} SELECT period, CAST(count(*) AS BIGINT) AS sample_size_minutes, {_all_correlations()}
  FROM indexed GROUP BY period""")
def period_compare(spark: SparkSession, sf: str) -> DataFrame:
    fact = period_fact(feeds(events(spark, sf)), OVERLAPPING, "hour")
    return _round_correlations(correlate.weather_correlations(fact, KEY))


MATRIX = ("road_temperature", "bikes_in_use", "public_transport_activity", "flight_activity", "mean_delay_sec")


@register(fact_sql("hour") + ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round({corr_sql(x, y) if x != y else '1.0'}, 6) AS r FROM fact"
    for x in MATRIX for y in MATRIX) + ") SELECT x, y, max(r) AS r FROM cells GROUP BY x, y")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.correlation_matrix(hourly(spark, sf), MATRIX).select("x", "y", r6(F.col("r"), "r"))


@register(f"""{fact_sql('hour')}, z AS (
  SELECT date_trunc('hour', ts) AS minute, 'n' || c_nationkey AS zone, avg(value) AS zt
  FROM ev JOIN customer ON c_custkey = user_id WHERE event_type = 'view' AND value BETWEEN -50 AND 50 GROUP BY ALL)
SELECT zone, round({corr_sql('zt', 'bikes_in_use')}, 6) AS temperature_vs_bikes,
  round({corr_sql('zt', 'mean_delay_sec')}, 6) AS temperature_vs_delay, CAST(count(*) AS BIGINT) AS n_minutes
FROM z JOIN fact USING (minute) GROUP BY zone""")
def corr_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    named = feeds(events(spark, sf))
    mapping = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("location"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("zone"))
    zoned = weather_minutes(with_zone(named["road_weather"], mapping).where(F.col("zone").isNotNull()), ("zone",), "hour")
    out = correlate.zone_correlations(zoned, minute_fact(named, unit="hour"))
    return out.select("zone", r6(F.col("temperature_vs_bikes"), "temperature_vs_bikes"),
                      r6(F.col("temperature_vs_delay"), "temperature_vs_delay"), "n_minutes")


# Two-sided p of the t distribution by Simpson's rule on its density.
P_SQL = """(SELECT 1 - 2 * (abs({t}) / 3000.0) * sum(
    (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
    exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi())
        - ({df} + 1) / 2 * ln(1 + pow(abs({t}) * i / 1000.0, 2) / {df})))
  FROM generate_series(0, 1000) AS g(i))"""


def pearson_sql(label: str) -> str:
    """Final select over `stats(period, <label>, n, r)`; fewer than four pairs have no statistics."""
    t = "(r * sqrt(n - 2) / sqrt(1 - r * r))"
    return f"""SELECT period, {label}, n, round(r, 3) AS r, CASE WHEN abs(r) < 1 THEN round({P_SQL.format(t=t, df='(n - 2.0)')}, 6) END AS p,
  CASE WHEN abs(r) < 1 THEN round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 3) END AS ci_low,
  CASE WHEN abs(r) < 1 THEN round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 3) END AS ci_high,
  CASE WHEN n >= 4 THEN 'ok' ELSE 'insufficient data' END AS status
FROM (SELECT period, {label}, n, CASE WHEN n >= 4 THEN r END AS r FROM stats)"""


def _pair_stats(pairs: dict[str, tuple[str, str]], label: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT period, '{k}' AS {label}, CAST(count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS BIGINT) AS n, "
        f"{corr_sql(x, y)} AS r FROM {source} GROUP BY period" for k, (x, y) in pairs.items())


def _p6(df: DataFrame) -> DataFrame:
    return df.withColumn("p", rounded("p", 6))


MODE_PAIRS = {
    f"{a}~{b}": (correlate.MODES[a], correlate.MODES[b])
    for i, a in enumerate(correlate.MODES) for b in list(correlate.MODES)[i + 1:]
}


@register(f"{fact_sql('hour', JANUARY)}, stats AS ({_pair_stats(MODE_PAIRS, 'pair', 'fact')}) {pearson_sql('pair')}")
def mode_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(correlate.mode_interactions(january(spark, sf), KEY))


@register(f"""{fact_sql('hour', JANUARY)}, d AS (
  SELECT period, road_temperature, mean_delay_sec FROM fact WHERE mean_delay_sec IS NOT NULL),
cut AS (SELECT period, quantile_cont(mean_delay_sec, 0.01) AS lo, quantile_cont(mean_delay_sec, 0.99) AS hi FROM d GROUP BY period),
ready AS (SELECT d.period, road_temperature, mean_delay_sec AS raw, least(greatest(mean_delay_sec, lo), hi) AS winsor,
  ln(1 + greatest(mean_delay_sec, 0)) AS log1p FROM d JOIN cut USING (period)),
stats AS ({_pair_stats({t: ('road_temperature', t) for t in ('raw', 'winsor', 'log1p')}, 'treatment', 'ready')})
{pearson_sql('treatment')}""")
def delay_robustness(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(correlate.delay_robustness(january(spark, sf), KEY))


@register(f"""{fact_sql('hour', JANUARY)}, fit AS (SELECT period, regr_count(mean_delay_sec, road_temperature)::BIGINT AS n,
    regr_slope(mean_delay_sec, road_temperature) AS slope, regr_intercept(mean_delay_sec, road_temperature) AS intercept,
    regr_r2(mean_delay_sec, road_temperature) AS r_squared FROM fact GROUP BY period)
SELECT period, n, CASE WHEN n > 10 THEN round(slope, 6) END AS slope, CASE WHEN n > 10 THEN round(intercept, 6) END AS intercept,
  CASE WHEN n > 10 THEN round(r_squared, 6) END AS r_squared FROM fit""")
def ols_single(spark: SparkSession, sf: str) -> DataFrame:
    out = correlate.simple_regression(january(spark, sf), "mean_delay_sec", "road_temperature", KEY)
    return out.select("period", "n", *[r6(F.col(c), c) for c in ("slope", "intercept", "r_squared")])


@register(f"""{fact_sql('hour', JANUARY)}, m AS (
  SELECT period, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
    covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy
  FROM (SELECT period, mean_delay_sec AS y, road_temperature AS x1, wind_speed AS x2 FROM fact WHERE mean_delay_sec IS NOT NULL)
  GROUP BY period),
beta AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
o AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * s1y + b2 * s2y) / syy AS r2 FROM beta WHERE n > 10)
SELECT period, 'intercept' AS term, round(b0, 6) AS coefficient, round(r2, 6) AS r_squared, CAST(n AS BIGINT) AS n FROM o
UNION ALL SELECT period, 'road_temperature', round(b1, 6), round(r2, 6), CAST(n AS BIGINT) FROM o
UNION ALL SELECT period, 'wind_speed', round(b2, 6), round(r2, 6), CAST(n AS BIGINT) FROM o""")
def ols_two(spark: SparkSession, sf: str) -> DataFrame:
    out = correlate.regression(january(spark, sf), others=("wind_speed",), keys=KEY)
    return out.select("period", "term", r6(F.col("coefficient"), "coefficient"), r6(F.col("r_squared"), "r_squared"), "n")


def _projected(target: str, steps: int) -> str:
    """Coefficients of a column on the residuals e1..e(steps), per period."""
    return ", ".join(f"sum({target} * e{i}) OVER w / sum(e{i} * e{i}) OVER w AS {target}_{i}" for i in range(1, steps + 1))


def _residual(target: str, steps: int) -> str:
    return " - ".join([target, *[f"{target}_{i} * e{i}" for i in range(1, steps + 1)]])


OVER_PERIOD = "WINDOW w AS (PARTITION BY period)"


@register(f"""{fact_sql('hour', JANUARY)}, c AS (
  SELECT period, mean_delay_sec - avg(mean_delay_sec) OVER w AS y, road_temperature - avg(road_temperature) OVER w AS x1,
    precipitation_intensity - avg(precipitation_intensity) OVER w AS x2, wind_speed - avg(wind_speed) OVER w AS x3,
    relative_humidity - avg(relative_humidity) OVER w AS x4, avg(mean_delay_sec) OVER w AS my, avg(road_temperature) OVER w AS m1,
    avg(precipitation_intensity) OVER w AS m2, avg(wind_speed) OVER w AS m3, avg(relative_humidity) OVER w AS m4
  FROM fact WHERE mean_delay_sec IS NOT NULL {OVER_PERIOD}),
s1 AS (SELECT *, x1 AS e1 FROM c),
s2 AS (SELECT *, {_residual('x2', 1)} AS e2 FROM (SELECT *, {_projected('x2', 1)} FROM s1 {OVER_PERIOD})),
s3 AS (SELECT *, {_residual('x3', 2)} AS e3 FROM (SELECT *, {_projected('x3', 2)} FROM s2 {OVER_PERIOD})),
s4 AS (SELECT *, {_residual('x4', 3)} AS e4 FROM (SELECT *, {_projected('x4', 3)} FROM s3 {OVER_PERIOD})),
g AS (SELECT *, {_projected('y', 4)}, sum(y * y) OVER w AS yy, sum(e1 * e1) OVER w AS q1, sum(e2 * e2) OVER w AS q2,
  sum(e3 * e3) OVER w AS q3, sum(e4 * e4) OVER w AS q4, count(*) OVER w AS n FROM s4 {OVER_PERIOD}),
one AS (SELECT DISTINCT ON (period) * FROM g WHERE n > 10),
back AS (SELECT *, y_4 AS b4, y_3 - x4_3 * y_4 AS b3, y_2 - x3_2 * (y_3 - x4_3 * y_4) - x4_2 * y_4 AS b2 FROM one),
solved AS (SELECT *, y_1 - x2_1 * b2 - x3_1 * b3 - x4_1 * b4 AS b1,
  (y_1 * y_1 * q1 + y_2 * y_2 * q2 + y_3 * y_3 * q3 + y_4 * y_4 * q4) / yy AS r2 FROM back)
SELECT period, term, round(b, 6) AS coefficient, round(r2, 6) AS r_squared, CAST(n AS BIGINT) AS n FROM (
  SELECT *, 'intercept' AS term, my - b1 * m1 - b2 * m2 - b3 * m3 - b4 * m4 AS b FROM solved
  UNION ALL SELECT *, 'road_temperature', b1 FROM solved UNION ALL SELECT *, 'precipitation_intensity', b2 FROM solved
  UNION ALL SELECT *, 'wind_speed', b3 FROM solved UNION ALL SELECT *, 'relative_humidity', b4 FROM solved)""")
def ols_weather(spark: SparkSession, sf: str) -> DataFrame:
    out = correlate.regression(january(spark, sf), keys=KEY)
    return out.select("period", "term", r6(F.col("coefficient"), "coefficient"), r6(F.col("r_squared"), "r_squared"), "n")


@register(f"""{PERIOD_INDEXED}, c AS (SELECT period, {", ".join(
    f"{corr_sql('road_temperature', y)} AS {n}" for n, y in correlate.RESPONSES.items())} FROM indexed GROUP BY period)
SELECT period, 'bikes' AS response, round(bikes, 6) AS r, CASE WHEN bikes IS NULL THEN 'missing' WHEN bikes < -0.3 THEN 'below' ELSE 'otherwise' END AS verdict FROM c
UNION ALL SELECT period, 'public_transport', round(public_transport, 6), CASE WHEN public_transport IS NULL THEN 'missing' WHEN public_transport < -0.3 THEN 'below' ELSE 'otherwise' END FROM c
UNION ALL SELECT period, 'flight_activity', round(flight_activity, 6), CASE WHEN flight_activity IS NULL THEN 'missing' WHEN flight_activity > 0.3 THEN 'above' ELSE 'otherwise' END FROM c
UNION ALL SELECT period, 'multimodal', round(multimodal, 6), CASE WHEN multimodal IS NULL THEN 'missing' WHEN multimodal > 0.2 THEN 'above' WHEN multimodal < -0.2 THEN 'below' ELSE 'otherwise' END FROM c
UNION ALL SELECT period, 'delay', round(delay, 6), CASE WHEN delay IS NULL THEN 'missing' WHEN delay > 0.2 THEN 'above' WHEN delay < -0.2 THEN 'below' ELSE 'otherwise' END FROM c""")
def interpretation(spark: SparkSession, sf: str) -> DataFrame:
    from urbanpulse.fixed import INTERPRETATION

    out = correlate.interpretations(correlate.weather_correlations(january(spark, sf), KEY), KEY)
    verdict = F.coalesce(*[
        F.when((F.col("response") == name) & (F.col("interpretation") == (rule[k][1] if isinstance(rule[k], tuple) else rule[k])), F.lit(k))
        for name, rule in INTERPRETATION.items() for k in rule])
    return out.select("period", "response", r6(F.col("r"), "r"), verdict.alias("verdict"))


def _split_sql(metrics: dict[str, str], source: str, label: str = "metric") -> str:
    """(period, label, counts, means, variances) in and out of the rush hour."""
    return " UNION ALL ".join(
        f"SELECT period, '{k}' AS {label}, CAST(count({c}) FILTER ({PEAK}) AS BIGINT) AS n1, CAST(count({c}) FILTER (NOT {PEAK}) AS BIGINT) AS n2, "
        f"avg({c}) FILTER ({PEAK}) AS m1, avg({c}) FILTER (NOT {PEAK}) AS m2, "
        f"var_samp({c}) FILTER ({PEAK}) AS v1, var_samp({c}) FILTER (NOT {PEAK}) AS v2 FROM {source} GROUP BY period"
        for k, c in metrics.items())


# Log density of the t distribution at x, and its distribution function by Simpson's rule.
DENSITY = ("exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + {x} * {x} / {df}))")
BELOW = ("(SELECT 0.5 + ({t} / 3000.0) * sum((CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
         + DENSITY.format(df="{df}", x="({t} * i / 1000.0)") + ") FROM generate_series(0, 1000) AS g(i))")


def welch_sql(label: str = "metric") -> str:
    """Test over `split`. The t quantile is found by Newton's method from the normal one, which
    approaches it from below since the distribution function is concave there."""
    step = f"t - ({BELOW.format(t='t', df='df')} - 0.975) / {DENSITY.format(df='df', x='t')}"
    return f"""checked AS (SELECT *, n1 >= 2 AND n2 >= 2 AS ok FROM split),
welch AS (SELECT *, v1 / n1 + v2 / n2 AS s2, CASE WHEN ok THEN m1 / nullif(m2, 0) END AS ratio,
    CASE WHEN ok THEN (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) END AS t,
    CASE WHEN ok THEN pow(v1 / n1 + v2 / n2, 2) / nullif(pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1), 0) END AS df FROM checked),
newton AS (SELECT DISTINCT df, 1.959963984540054::DOUBLE AS t, 0 AS step FROM welch WHERE df IS NOT NULL
  UNION ALL SELECT df, {step}, step + 1 FROM newton WHERE step < 30),
tested AS (SELECT welch.*, CASE WHEN t IS NOT NULL THEN {P_SQL.format(t='welch.t', df='welch.df')} END AS p, q.q * sqrt(s2) AS reach
  FROM welch LEFT JOIN (SELECT df, t AS q FROM newton WHERE step = 30) q ON q.df = welch.df)
SELECT period, {label}, n1 AS n_peak, n2 AS n_offpeak, round(m1, 3) AS mean_peak, round(m2, 3) AS mean_offpeak,
  round(ratio, 3) AS ratio, round(t, 3) AS welch_t, round(df, 6) AS df, round(p, 6) AS p,
  round(m1 - m2 - reach, 3) AS ci_low, round(m1 - m2 + reach, 3) AS ci_high,
  abs(ratio - 1) < 0.02 AND p < 0.05 AS trivial_effect, CASE WHEN ok THEN 'ok' ELSE 'insufficient data' END AS status FROM tested"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _welch6(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c, 6) for c in ("df", "p")})


@register(recursive(f"{PERIOD_INDEXED}, split AS ({_split_sql(peak.METRICS, 'indexed')}), {welch_sql()}"))
def peak_offpeak_welch(spark: SparkSession, sf: str) -> DataFrame:
    return _welch6(peak.peak_offpeak(january(spark, sf), keys=KEY))


VARIANT_SQL = f"{fact_sql('hour', JANUARY)}, variants AS (SELECT period, minute, road_temperature, " + ", ".join(
    f"{index_sql(c, 'PARTITION BY period')} AS {v}" for v, c in INDEX_VARIANTS.items()) + " FROM fact)"


@register(recursive(f"{VARIANT_SQL}, split AS ({_split_sql({v: v for v in INDEX_VARIANTS}, 'variants', 'variant')}), {welch_sql('variant')}"))
def variant_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return _welch6(peak.variant_peaks(january(spark, sf), KEY))


@register(f"""{VARIANT_SQL}, stats AS ({_pair_stats({v: ('road_temperature', v) for v in INDEX_VARIANTS}, 'variant', 'variants')})
{pearson_sql('variant')}""")
def variant_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(peak.variant_correlations(january(spark, sf), KEY))


RATIO_METRICS = {k: c for k, c in peak.METRICS.items() if k != "delay"}


@register(f"""{PERIOD_INDEXED}, split AS ({_split_sql(RATIO_METRICS, 'indexed')})
SELECT metric, round((sum(n1 * m1) / sum(n1)) / (sum(n2 * m2) / sum(n2)), 6) AS weighted_ratio,
  round(min(m1 / m2), 6) AS range_min, round(max(m1 / m2), 6) AS range_max, CAST(count(*) AS BIGINT) AS n_windows
FROM split WHERE n1 >= 2 AND n2 >= 2 GROUP BY metric""")
def pooled_ratio(spark: SparkSession, sf: str) -> DataFrame:
    out = peak.pooled_ratio(peak.window_ratios(january(spark, sf), RATIO_METRICS, KEY))
    return out.select("metric", *[r6(F.col(c), c) for c in ("weighted_ratio", "range_min", "range_max")], "n_windows")


SUMMARY = {n: c for n, c in (correlate.RESPONSES | correlate.TEMPERATURE_ONLY).items()}


@register(f"""{PERIOD_INDEXED} SELECT period, '06-18' AS part_of_day, {", ".join(
    f"round({corr_sql('road_temperature', c)}, 6) AS temperature_vs_{n}" for n, c in SUMMARY.items())},
  CAST(count(*) AS BIGINT) AS sample_size_minutes FROM indexed
  WHERE extract(hour FROM minute) >= 6 AND extract(hour FROM minute) < 18 GROUP BY period""")
def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    fact = period_fact(feeds(events(spark, sf)), JANUARY, "hour", hours=(6, 18))
    return _round_correlations(summary_row(correlate.weather_correlations(fact, KEY), hours="06-18"))


@register(f"""{fact_sql("minute")} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, round(road_temperature, 6) AS road_temperature, round(bikes_in_use, 6) AS bikes_in_use
FROM fact ORDER BY md5(CAST(epoch(minute) AS BIGINT) || ':42'), minute LIMIT 5000""")
def plot_sample(spark: SparkSession, sf: str) -> DataFrame:
    fact = minute_fact(feeds(events(spark, sf)))
    return correlate.plot_sample(fact).select(
        clock(F.col("minute")), r6(F.col("road_temperature"), "road_temperature"), r6(F.col("bikes_in_use"), "bikes_in_use"))


QUERIES, ORACLES = register.queries, register.oracles
