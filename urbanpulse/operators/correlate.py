"""Correlation, regression and interpretation over the fact table.

Each family of statistics is one grouped aggregation, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.fixed import INTERPRETATION, MIN_PEARSON_ROWS, MIN_REGRESSION_ROWS, WINSOR_TAILS
from urbanpulse.functions.stats import pair_count, paired, pearson_columns, safe_corr

RESPONSES = {
    "bikes": "bikes_in_use",
    "public_transport": "public_transport_activity",
    "flight_activity": "flight_activity",
    "multimodal": "multimodal_activity",
    "delay": "mean_delay_sec",
}
TEMPERATURE_ONLY = {"travel_time": "mean_travel_time_sec", "traffic_incidents": "traffic_incident_count"}
PREDICTORS = {
    "precipitation": "precipitation_intensity",
    "wind_speed": "wind_speed",
    "relative_humidity": "relative_humidity",
}
MODES = {
    "bike": "bikes_in_use",
    "public_transport": "public_transport_activity",
    "flight": "flight_activity",
    "delay": "mean_delay_sec",
}


def _present(fact: DataFrame, name: str) -> Column:
    return F.col(name) if name in fact.columns else F.lit(None).cast("double")


def weather_correlations(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All 22 named predictor-response correlations and the pair counts of the main five, in one pass."""
    temperature = _present(fact, "road_temperature")
    out = [safe_corr(temperature, _present(fact, c)).alias(f"temperature_vs_{n}")
           for n, c in (RESPONSES | TEMPERATURE_ONLY).items()]
    for predictor, column in PREDICTORS.items():
        out += [safe_corr(_present(fact, column), _present(fact, c)).alias(f"{predictor}_vs_{n}")
                for n, c in RESPONSES.items()]
    out += [pair_count(temperature, _present(fact, c)).alias(f"n_temperature_vs_{n}") for n, c in RESPONSES.items()]
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size_minutes"), *out)


def correlation_matrix(fact: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Full symmetric matrix in long form (x, y, r); the diagonal is 1 for a column that varies."""
    columns = [c for c in columns if c in fact.columns]
    pairs = list(combinations(columns, 2))
    wide = fact.groupBy(*keys).agg(
        *[safe_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs],
        *[F.when(F.max(c) > F.min(c), F.lit(1.0)).alias(f"{c}|{c}") for c in columns],
    )

    def cell(a: str, b: str) -> Column:
        known = f"{a}|{b}" if f"{a}|{b}" in wide.columns else f"{b}|{a}"
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{known}`").cast("double").alias("r"))

    cells = F.explode(F.array(*[cell(a, b) for a in columns for b in columns])).alias("c")
    return wide.select(*keys, cells).select(*keys, "c.x", "c.y", "c.r")


def pair_correlations(fact: DataFrame, pairs: dict[str, tuple[str, str]], keys: Sequence[str] = (),
                      label: str = "pair", min_rows: int = MIN_PEARSON_ROWS) -> DataFrame:
    """Pearson r with t-test and 95 % interval for named column pairs, long form.

    Below `min_rows` complete pairs the statistics are null and the status says so.
    """
    wide = fact.groupBy(*keys).agg(
        *[pair_count(F.col(a), F.col(b)).alias(f"n|{k}") for k, (a, b) in pairs.items()],
        *[safe_corr(F.col(a), F.col(b)).alias(f"r|{k}") for k, (a, b) in pairs.items()],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(k).alias(label), F.col(f"`n|{k}`").alias("n"), F.col(f"`r|{k}`").alias("_r")) for k in pairs
    ])).alias("c")
    rows = wide.select(*keys, cells).select(*keys, f"c.{label}", "c.n", "c._r")
    enough = F.col("n") >= min_rows
    return rows.withColumn("_r", F.when(enough, F.col("_r"))).select(
        *keys, label, "n", *pearson_columns(F.col("_r"), F.col("n")),
        F.when(enough, "ok").otherwise("insufficient data").alias("status"),
    )


def mode_interactions(fact: DataFrame, keys: Sequence[str] = (), modes: dict[str, str] = MODES) -> DataFrame:
    """All pairs of transport modes and the delay."""
    present = {k: c for k, c in modes.items() if c in fact.columns}
    pairs = {f"{a}~{b}": (present[a], present[b]) for a, b in combinations(present, 2)}
    return pair_correlations(fact, pairs, keys)


def delay_robustness(fact: DataFrame, keys: Sequence[str] = ("period",), x: str = "road_temperature",
                     y: str = "mean_delay_sec", tails: tuple[float, float] = WINSOR_TAILS) -> DataFrame:
    """Temperature against delay: raw, winsorized at both tails, and log1p of the positive part.

    The fact table has at most one row per minute of a period, so the tails are taken with
    the built-in exact percentile.
    """
    complete = fact.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cuts = complete.groupBy(*keys).agg(F.percentile(y, F.array(*[F.lit(t) for t in tails])).alias("_cut"))
    ready = complete.join(cuts, list(keys)).select(
        *keys, x, F.col(y).alias("raw"),
        F.least(F.greatest(F.col(y), F.col("_cut")[0]), F.col("_cut")[1]).alias("winsor"),
        F.log1p(F.greatest(F.col(y), F.lit(0.0))).alias("log1p"),
    )
    return pair_correlations(ready, {t: (x, t) for t in ("raw", "winsor", "log1p")}, keys, "treatment")


def zone_correlations(zone_weather: DataFrame, fact: DataFrame, keys: Sequence[str] = (),
                      responses: dict[str, str] | None = None) -> DataFrame:
    """Zone temperature against the fact table's measures: one inner join, one grouped aggregate."""
    responses = responses or {"bikes": "bikes_in_use", "delay": "mean_delay_sec"}
    joined = zone_weather.select(*keys, "minute", "zone", F.col("road_temperature").alias("zone_temperature")).join(
        fact.select(*keys, "minute", *responses.values()), [*keys, "minute"])
    return joined.groupBy(*keys, "zone").agg(
        *[safe_corr(F.col("zone_temperature"), F.col(c)).alias(f"temperature_vs_{n}") for n, c in responses.items()],
        F.count(F.lit(1)).alias("n_minutes"),
    )


FIT = T.StructType([
    T.StructField("intercept", T.DoubleType()),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("r_squared", T.DoubleType()),
])


def simple_regression(fact: DataFrame, y: str, x: str, keys: Sequence[str] = (),
                      min_rows: int = MIN_REGRESSION_ROWS) -> DataFrame:
    """Least squares on one predictor, all from built-in aggregates; none for a constant response."""
    px, py = paired(F.col(x), F.col(y))
    n, enough = F.count(px), (F.count(px) >= min_rows) & (F.max(py) > F.min(py)) & (F.max(px) > F.min(px))
    slope = F.try_divide(F.covar_pop(px, py), F.var_pop(px))
    fit = F.try_divide(F.covar_pop(px, py) * F.covar_pop(px, py), F.var_pop(px) * F.var_pop(py))
    return fact.groupBy(*keys).agg(
        n.alias("n"), F.when(enough, slope).alias("slope"),
        F.when(enough, F.avg(py) - slope * F.avg(px)).alias("intercept"), F.when(enough, fit).alias("r_squared"))


@F.pandas_udf(FIT)
def _solve(means: pd.Series, cross: pd.Series) -> pd.DataFrame:
    """Normal equations of one result row; the last variable is the response."""
    rows = []
    for m, c in zip(means, cross):
        if m is None or c is None or any(v is None for v in m) or any(v is None for v in c):
            rows.append((None, None, None))
            continue
        k = len(m)
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = c
        full = full + np.triu(full, 1).T
        xx, xy, yy = full[:-1, :-1], full[:-1, -1], full[-1, -1]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        intercept = float(m[-1] - beta @ np.asarray(m[:-1]))
        residual = yy - 2 * beta @ xy + beta @ xx @ beta
        rows.append((intercept, [float(b) for b in beta], float(1 - residual / yy) if yy > 0 else None))
    return pd.DataFrame(rows, columns=["intercept", "coefficients", "r_squared"])


def _fit_columns(y: str, xs: Sequence[str], complete: Column, tag: str) -> list[Column]:
    """Count, means and upper-triangle covariances of the complete rows."""
    kept = [F.when(complete, F.col(c).cast("double")) for c in (*xs, y)]
    cross = [F.covar_pop(kept[i], kept[j]) for i in range(len(kept)) for j in range(i, len(kept))]
    return [F.count(kept[-1]).alias(f"_n_{tag}"), F.array(*[F.avg(v) for v in kept]).alias(f"_mean_{tag}"),
            F.array(*cross).alias(f"_cross_{tag}")]


def regression(fact: DataFrame, y: str = "mean_delay_sec", first: str = "road_temperature",
               others: Sequence[str] = tuple(PREDICTORS.values()), keys: Sequence[str] = (),
               min_rows: int = MIN_REGRESSION_ROWS) -> DataFrame:
    """Least squares of the delay on the weather, long form (one row per coefficient).

    One aggregation collects covariances of the rows complete in all predictors and of those
    complete in the first alone; the second fit is used when the first has too few rows.
    """
    xs = [first, *[c for c in others if c in fact.columns]]
    both = F.col(y).isNotNull() & F.col(first).isNotNull()
    every = both
    for c in xs[1:]:
        every = every & F.col(c).isNotNull()
    sums = fact.groupBy(*keys).agg(*_fit_columns(y, xs, every, "all"), *_fit_columns(y, [first], both, "one"))
    full = F.col("_n_all") >= min_rows
    one = ~full & (F.col("_n_one") >= min_rows)
    chosen = sums.select(
        *keys,
        F.when(full, F.col("_n_all")).otherwise(F.col("_n_one")).alias("n"),
        F.when(full, F.col("_mean_all")).when(one, F.col("_mean_one")).alias("_m"),
        F.when(full, F.col("_cross_all")).when(one, F.col("_cross_one")).alias("_c"),
        F.when(full, F.array(*[F.lit(x) for x in xs])).otherwise(F.array(F.lit(first))).alias("_x"),
    ).where(F.col("_m").isNotNull())
    fitted = chosen.withColumn("_fit", _solve("_m", "_c"))
    terms = F.arrays_zip(F.concat(F.array(F.lit("intercept")), F.col("_x")).alias("term"),
                         F.concat(F.array(F.col("_fit.intercept")), F.col("_fit.coefficients")).alias("value"))
    return fitted.select(*keys, "n", F.col("_fit.r_squared").alias("r_squared"), F.explode(terms).alias("t")).select(
        *keys, F.col("t.term").alias("term"), F.col("t.value").alias("coefficient"), "r_squared", "n")


def interpretations(correlations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A sentence per response, chosen by thresholds on its temperature correlation."""
    def sentence(name: str, rule: dict) -> Column:
        r = F.col(f"temperature_vs_{name}")
        chain = F.when(r.isNull(), F.lit(rule["missing"]))
        if "above" in rule:
            chain = chain.when(r > rule["above"][0], F.lit(rule["above"][1]))
        if "below" in rule:
            chain = chain.when(r < rule["below"][0], F.lit(rule["below"][1]))
        return F.struct(F.lit(name).alias("response"), r.alias("r"),
                        chain.otherwise(F.lit(rule["otherwise"])).alias("interpretation"))

    rows = F.explode(F.array(*[sentence(n, rule) for n, rule in INTERPRETATION.items()])).alias("i")
    return correlations.select(*keys, rows).select(*keys, "i.response", "i.r", "i.interpretation")


def plot_sample(fact: DataFrame, rows: int = 5000, seed: int = 42) -> DataFrame:
    """A reproducible sample of minutes in time order: smallest hashes first, then sorted."""
    name = F.concat_ws(":", F.unix_seconds("minute").cast("string"), F.lit(seed).cast("string"))
    picked = fact.orderBy(F.md5(name.cast("binary")), "minute").limit(rows)
    return picked.orderBy("minute")
