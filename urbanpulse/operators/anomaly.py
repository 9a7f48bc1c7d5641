"""Preparation of hourly features and the tables made from detected anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.fixed import BOX_EPSILON, BOX_WHISKER, ROLLING_ROWS, SCORE_BINS
from urbanpulse.functions.rounding import rounded
from urbanpulse.operators.forest import detect
from urbanpulse.operators.quantiles import exact_quantiles
from urbanpulse.session import beside, materialise

DIGITS = 9  # of z-scores that forests see


def medians(rows: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median of each feature per group, whatever the size of a group."""
    long = rows.select(*group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("f")
    ).select(*group, "f.feature", "f.value")
    found = exact_quantiles(long, [*group, "feature"], "value", {"median": 0.5})
    return found.groupBy(*group).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_median_{c}") for c in features])


def standardise(rows: DataFrame, group: Sequence[str], features: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Median for gaps, then z-scores with the population deviation; a constant feature is divided by 1.

    A group without any value of a feature has no median, and that feature stays null there.
    """
    group = list(group)
    filled = beside(rows, medians(rows, group, features), group, "left")
    filled = filled.select(*rows.columns, *[
        F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")).alias(f"_fill_{c}") for c in features])
    moments = filled.groupBy(*group).agg(
        *[F.avg(f"_fill_{c}").alias(f"_mean_{c}") for c in features],
        *[F.when(F.max(f"_fill_{c}") > F.min(f"_fill_{c}"), F.stddev_pop(f"_fill_{c}")).otherwise(1.0)
          .alias(f"_sd_{c}") for c in features])
    return beside(filled, moments, group).select(*rows.columns, *[
        F.try_divide(F.col(f"_fill_{c}") - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")).alias(f"{c}{suffix}")
        for c in features])


def detect_anomalies(rows: DataFrame, group: Sequence[str], features: Sequence[str], row_id: str, **forest) -> DataFrame:
    """Impute, standardise, fit and score, for every group at once.

    The standardised rows are written once: sampling and scoring both read them. Scores are rounded to DIGITS, so that values
    which differ by the order of adding only count as equal.
    """
    z = standardise(rows, group, features)
    ready = materialise(z.withColumns({f"{c}_z": rounded(F.col(f"{c}_z"), DIGITS) for c in features}))
    scored = detect(ready, group, [f"{c}_z" for c in features], row_id, **forest)
    return scored.drop(*[f"{c}_z" for c in features])


def precision(anomaly: Column, known: Column) -> Column:
    """Share of detected rows that are known anomalies; 0 when none is detected."""
    hit = F.count_if(anomaly & F.coalesce(known, F.lit(False)))
    return rounded(F.coalesce(F.try_divide(hit, F.count_if(anomaly)), F.lit(0.0)), 2)


def anomaly_summary(scored: DataFrame, group: Sequence[str] = ("period", "mode")) -> DataFrame:
    """Rows, anomalies, rate, score moments and precision per group."""
    n, score = F.count(F.lit(1)), F.col("if_score")
    deviation = F.sqrt(F.try_divide(F.var_pop(score) * n, n - 1))
    known = precision(F.col("anomaly"), F.col("injected")) if "injected" in scored.columns else F.lit(None).cast("double")
    return scored.groupBy(*group).agg(
        n.alias("hours"), F.count_if("anomaly").alias("anomalies"),
        rounded(F.count_if("anomaly") * 100.0 / n, 2).alias("anomaly_rate_pct"),
        rounded(F.avg(score), 4).alias("score_mean"), rounded(deviation, 4).alias("score_std"),
        rounded(F.min(score), 4).alias("score_min"), known.alias("precision"))


def anomaly_heatmap(scored: DataFrame, hour: str = "hour", group: Sequence[str] = ("mode",)) -> DataFrame:
    """Anomaly rate by weekday (0 is Monday) and hour of day, 0 where there is no data; all 7 x 24 cells.

    The 24 columns are one conditional average each; the empty weekdays come from the group list.
    """
    flag = F.col("anomaly").cast("double")
    rates = scored.groupBy(*group, F.weekday(hour).alias("weekday")).agg(
        *[F.avg(F.when(F.hour(hour) == h, flag)).alias(f"h{h:02d}") for h in range(24)])
    frame = scored.select(*group).distinct().withColumn(
        "weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return frame.join(rates, [*group, "weekday"], "left").fillna(0.0, [f"h{h:02d}" for h in range(24)])


def score_boundary(scored: DataFrame, group: Sequence[str] = ("mode",)) -> DataFrame:
    """Largest score still labelled an anomaly, pooled over periods."""
    return scored.groupBy(*group).agg(F.max(F.when(F.col("if_label") == -1, F.col("if_score"))).alias("boundary"))


def score_histogram(scored: DataFrame, group: Sequence[str] = ("period", "mode"), value: str = "if_score",
                    bins: int = SCORE_BINS) -> DataFrame:
    """Equal-width bins over each group's own span; the top edge belongs to the last bin."""
    group = list(group)
    span = scored.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    place = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int") + 1
    return beside(scored.where(F.col(value).isNotNull()), span, group).groupBy(*group, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def box_stats(rows: DataFrame, features: Sequence[str], group: Sequence[str] = ("mode",),
              flag: str = "anomaly") -> DataFrame:
    """Box-plot data of min-max scaled features, split by the anomaly flag.

    Quartiles are exact for groups of any size; whiskers end at the furthest value within 1.5 quartile ranges.
    """
    group = list(group)
    long = rows.select(*group, flag, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("f")
    ).select(*group, flag, "f.feature", "f.v")
    key = [*group, "feature"]
    span = long.groupBy(*key).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = beside(long, span, key).select(
        *key, flag, ((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + BOX_EPSILON)).alias("v"))
    cells = [*key, flag]
    quartiles = exact_quantiles(scaled, cells, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = BOX_WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return beside(scaled, quartiles, cells).groupBy(*cells).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def rolling_density(scored: DataFrame, group: Sequence[str] = ("period", "mode"), hour: str = "hour",
                    rows: int = ROLLING_ROWS) -> DataFrame:
    """Share of anomalies in the last 24 rows, and the row's offset from the period start.

    The window spans one group's hours, so its size is set by the calendar.
    """
    order = W.partitionBy(*group).orderBy(hour)
    return scored.select(
        *group, hour, (F.row_number().over(order) - 1).alias("hour_offset"),
        F.avg(F.col("anomaly").cast("double")).over(order.rowsBetween(1 - rows, 0)).alias("density"))
