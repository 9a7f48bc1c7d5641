"""Fact table, periods and statistics on literal rows."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanpulse.fixed import PERIOD_SETS, Period, days
from urbanpulse.functions import tdist
from urbanpulse.functions.rounding import rounded
from urbanpulse.functions.stats import safe_corr
from urbanpulse.operators import correlate, peak
from urbanpulse.operators.minute_fact import minute_fact, records_per_source, valid_temperature, with_index, with_variants
from urbanpulse.operators.periods import day_end, in_window, part_of_day, window_bounds, with_period_table, with_periods
from urbanpulse.operators import quantiles
from urbanpulse.operators.quantiles import exact_quantiles
from urbanpulse.plans.impact import analyse, period_fact
from urbanpulse.session import materialise

T0 = datetime(2026, 1, 30, 8)


def minute(i):
    return T0 + timedelta(minutes=i)


def feeds(spark, n=30):
    weather = spark.createDataFrame([(minute(i), float(i % 7), float(i)) for i in range(n)], "timestamp timestamp, road_temperature double, wind_speed double")
    bikes = spark.createDataFrame([(minute(i), float(i)) for i in range(n)] + [(minute(1), 10.0)], "timestamp timestamp, metric_value double")
    trips = spark.createDataFrame(
        [(int(minute(i).replace(tzinfo=timezone.utc).timestamp()),) * 2 + (i * 3, i) for i in range(n)],
        "timestamp bigint, departure_timestamp bigint, max_departure_delay_sec bigint, max_arrival_delay_sec bigint")
    return {"road_weather": weather, "bikes": bikes, "trips": trips}


def test_temperature_limits(spark):
    rows = spark.createDataFrame([(60.0,), (-60.0,), (float("nan"),), (None,), (50.0,), (-50.0,), (0.0,)], "t double")
    assert rows.where(valid_temperature(F.col("t"))).count() == 3
    assert rows.where(valid_temperature(F.col("t"), nonzero=True)).count() == 2


def test_fact_keeps_weather_minutes_and_nulls(spark):
    f = feeds(spark, 3)
    f["bikes"] = f["bikes"].where(F.col("timestamp") != F.lit(minute(2))).unionByName(
        spark.createDataFrame([(minute(9), 1.0)], "timestamp timestamp, metric_value double"))
    rows = {r["minute"]: r for r in minute_fact(f).collect()}
    assert set(rows) == {minute(0), minute(1), minute(2)}
    assert rows[minute(1)]["bikes_in_use"] == 11.0 and rows[minute(2)]["bikes_in_use"] is None
    assert rows[minute(2)]["flight_activity"] is None and rows[minute(2)]["mean_delay_sec"] == 6.0


def test_activity_falls_back_to_timestamp(spark):
    f = feeds(spark, 3)
    f["trips"] = f["trips"].withColumn("departure_timestamp", F.lit(None).cast("bigint"))
    assert minute_fact(f).agg(F.sum("public_transport_activity")).first()[0] == 3


def test_strict_weather(spark):
    weather = spark.createDataFrame([(T0, 1.0, 4.0), (T0, None, 8.0)], "timestamp timestamp, road_temperature double, wind_speed double")
    assert minute_fact({"road_weather": weather}).first()["wind_speed"] == 4.0
    assert minute_fact({"road_weather": weather}, strict=False).first()["wind_speed"] == 6.0


def test_index(spark):
    fact = spark.createDataFrame([(minute(0), 5.0, 1, None), (minute(1), 5.0, 3, None), (minute(2), 5.0, None, None)],
                                 "minute timestamp, bikes_in_use double, public_transport_activity bigint, flight_activity bigint")
    out = [r["multimodal_activity"] for r in with_index(fact).orderBy("minute").collect()]
    assert out == [pytest.approx(1 / 3), 1.0, 0.0]
    both = with_variants(fact, {"a": ["bikes_in_use"], "b": ["absent"]})
    assert {r["a"] for r in both.collect()} == {0.0} and {r["b"] for r in both.collect()} == {None}


def test_index_scaled_before_part_of_day(spark):
    f = {"road_weather": spark.createDataFrame([(datetime(2026, 1, 30, h), 1.0) for h in range(6)], "timestamp timestamp, road_temperature double"),
         "bikes": spark.createDataFrame([(datetime(2026, 1, 30, h), float(h)) for h in range(6)], "timestamp timestamp, metric_value double")}
    out = period_fact(f, (days("p", "2026-01-30", "2026-01-30"),), hours=(0, 4)).orderBy("minute").collect()
    assert len(out) == 4 and out[-1]["multimodal_activity"] == pytest.approx(0.6)


def test_periods_overlap_and_ends_count(spark):
    periods = (Period("a", datetime(2026, 1, 30), datetime(2026, 1, 31)), Period("b", datetime(2026, 1, 31), datetime(2026, 2, 2), weekend_only=True))
    rows = spark.createDataFrame([(datetime(2026, 1, 31),), (datetime(2026, 2, 2),), (datetime(2026, 2, 1),)], "ts timestamp")
    out = with_periods(rows, F.col("ts"), periods)
    assert sorted((r["period"], r["ts"].day) for r in out.collect()) == [("a", 31), ("b", 1), ("b", 31)]
    table = spark.createDataFrame([(p.name, p.start, p.end, p.weekday_only, p.weekend_only) for p in periods],
                                  "name string, start_date timestamp, end_date timestamp, weekday_only boolean, weekend_only boolean")
    assert sorted(map(tuple, with_period_table(rows, F.col("ts"), table).collect())) == sorted(map(tuple, out.collect()))
    folder = with_periods(rows.withColumn("d", F.lit("2026-02-01").cast("date")), F.col("ts"), periods, F.col("d"))
    assert {r["period"] for r in folder.collect()} == {"b"}


def test_window_defaults():
    now = datetime(2026, 2, 1, tzinfo=timezone.utc)
    assert window_bounds(None, None, 3, now)[0] == now - timedelta(days=3)
    assert window_bounds(None, now)[0].year == 1970
    assert day_end("2026-01-31") == datetime(2026, 1, 31, 23, 59, 59, 999999, tzinfo=timezone.utc)
    assert sorted(PERIOD_SETS) == sorted(["three_phases", "two_weeks", "dec_jan", "four_windows", "weekday_weekend", "jan30_feb16", "wa_wb_wc", "wa1_wa2_wb_wc"])


def test_weekday_wins(spark):
    rows = spark.createDataFrame([(datetime(2026, 1, 30),), (datetime(2026, 1, 31),)], "ts timestamp")
    kept = rows.where(in_window(F.col("ts"), datetime(2026, 1, 1), datetime(2026, 3, 1), True, True))
    assert [r["ts"].day for r in kept.collect()] == [30]
    assert rows.where(part_of_day(F.col("ts"), 0, 4)).count() == 2


def test_degenerate_correlations(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, None)], "x double, y double, z double")
    out = rows.agg(safe_corr(F.col("x"), F.col("y")).alias("c"), safe_corr(F.col("x"), F.col("z")).alias("one"), safe_corr(F.col("x"), F.col("x")).alias("self")).first()
    assert out["c"] is None and out["one"] is None and out["self"] == pytest.approx(1.0)
    assert correlate.simple_regression(rows, "y", "x", min_rows=2).first()["r_squared"] is None


def test_regression_matches_numpy_and_falls_back(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = 2 + x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=60)
    cols = ["road_temperature", "precipitation_intensity", "wind_speed", "relative_humidity"]
    fact = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "mean_delay_sec double, " + ", ".join(f"{c} double" for c in cols))
    out = {r["term"]: r for r in correlate.regression(fact).collect()}
    beta = np.linalg.lstsq(np.hstack([np.ones((60, 1)), x]), y, rcond=None)[0]
    for name, b in zip(["intercept", *cols], beta):
        assert out[name]["coefficient"] == pytest.approx(b)
    residual = y - np.hstack([np.ones((60, 1)), x]) @ beta
    assert out["intercept"]["r_squared"] == pytest.approx(1 - (residual @ residual) / ((y - y.mean()) ** 2).sum())
    sparse = fact.withColumn("wind_speed", F.when(F.col("wind_speed") > 1.5, F.col("wind_speed")))
    assert {r["term"] for r in correlate.regression(sparse).collect()} == {"intercept", "road_temperature"}
    assert correlate.regression(fact.limit(10)).count() == 0


def test_t_distribution():
    assert tdist.quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tdist.quantile(0.025, 1) == pytest.approx(-12.7062047, abs=1e-6)
    assert tdist.quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-5)
    assert tdist.two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tdist.two_sided_p(0.0, 5) == 1.0
    assert math.isnan(tdist.two_sided_p(math.inf, 5))


def test_pearson_few_rows_and_perfect(spark):
    fact = spark.createDataFrame([(float(i), float(2 * i), None if i else 1.0) for i in range(6)], "a double, b double, c double")
    out = {r["pair"]: r for r in correlate.pair_correlations(fact, {"ab": ("a", "b"), "ac": ("a", "c")}).collect()}
    assert out["ab"]["r"] == 1.0 and out["ab"]["ci_low"] is None and out["ab"]["status"] == "ok"
    assert out["ac"]["n"] == 1 and out["ac"]["r"] is None and out["ac"]["status"] == "insufficient data"


def test_welch_degenerate(spark):
    rows = [(datetime(2026, 1, 30, 8), 1.0)] + [(datetime(2026, 1, 30, 12), float(v)) for v in (0, 0, 0)]
    fact = spark.createDataFrame(rows, "minute timestamp, bikes_in_use double")
    out = peak.peak_offpeak(fact, {"bikes": "bikes_in_use"}).first()
    assert out["n_peak"] == 1 and out["status"] == "insufficient data" and out["p"] is None
    two = fact.unionByName(fact.limit(1))
    assert peak.peak_offpeak(two, {"bikes": "bikes_in_use"}).first()["ratio"] is None


def test_exact_quantiles_with_weights_ties_and_outliers(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 50, 3000), rng.normal(size=2000) * 1e-3, [1e12, -1e12]])
    rows = spark.createDataFrame([("g", float(v), 2) for v in values] + [(None, 1.0, 1)], "g string, v double, w bigint")
    for few in (50_000, 100):
        monkeypatch.setattr(quantiles, "FEW", few)
        out = {r["g"]: r for r in exact_quantiles(rows, ["g"], "v", {"m": 0.5, "p95": 0.95, "p1": 0.01}).collect()}
        assert [out["g"][c] for c in ("m", "p95", "p1")] == pytest.approx(list(np.percentile(values, [50, 95, 1])), abs=1e-12)
        assert out[None]["m"] == 1.0
        doubled = exact_quantiles(rows.where("g = 'g'"), ["g"], "v", {"m": 0.4}, "w").first()
        assert doubled["n"] == 2 * len(values) and doubled["m"] == pytest.approx(np.percentile(np.repeat(values, 2), 40), abs=1e-12)


def test_whole_analysis(spark):
    periods = (days("has", "2026-01-30", "2026-01-30"), days("empty", "2020-01-01", "2020-01-02"))
    zones = spark.createDataFrame([("s", "z")], "location string, zone string")
    f = feeds(spark)
    f["road_weather"] = f["road_weather"].withColumn("location", F.lit("s"))
    out = analyse(spark, f, periods, location_zone=zones)
    assert {(r["period"], r["status"]) for r in out.status.collect()} == {("has", "ok"), ("empty", "No weather data available for analysis")}
    assert out.correlations.count() == 1 and out.interpretation.count() == 5 and out.robustness.count() == 3
    assert out.interactions.count() == 6 and out.regression.count() > 0 and out.zone_correlations.count() == 1
    assert out.pooled.count() >= 0 and out.variants.count() == 2 and out.temperature.first()["n_readings"] == 30


def test_clock_is_chosen_for_each_period(spark):
    """One period's trips have departures, the other's have none."""
    f = feeds(spark, 4)
    late = F.col("timestamp") >= int(minute(2).replace(tzinfo=timezone.utc).timestamp())
    f["trips"] = f["trips"].withColumn("departure_timestamp", F.when(~late, F.col("departure_timestamp")))
    utc = lambda i, micros=0: (minute(i) - timedelta(microseconds=micros)).replace(tzinfo=timezone.utc)
    two = (Period("departures", utc(0), utc(2, 1)), Period("none", utc(2), utc(4)))
    both = {(r["period"], r["minute"]): r["public_transport_activity"] for r in period_fact(f, two).collect()}
    alone = {(r["period"], r["minute"]): r["public_transport_activity"] for p in two for r in period_fact(f, (p,)).collect()}
    assert both == alone and set(both.values()) == {1} and len(both) == 4


def test_records_per_source_count_minutes_without_weather(spark):
    f = feeds(spark, 3)
    f["road_weather"] = f["road_weather"].limit(1)
    got = {r["source"]: (r["n_records"], r["n_minutes"]) for r in records_per_source(f).collect()}
    assert got == {"road_weather": (1, 1), "bikes": (4, 3), "trips": (3, 3)}


def test_long_period_lists(spark):
    rows = spark.createDataFrame([(minute(i), minute(i).date()) for i in range(5)], "ts timestamp, date date")
    many = [Period(f"p{i}", T0 + timedelta(days=i), T0 + timedelta(days=i, hours=1)) for i in range(-150, 150)]
    short = [p for p in many if p.name in ("p0", "p1")]
    for folder in (None, F.col("date")):
        long, few = (sorted(map(str, with_periods(rows, F.col("ts"), ps, folder).collect())) for ps in (many, short))
        assert long == few and len(few) == 5


def test_rounding_at_both_ends(spark):
    row = spark.range(1).select(
        rounded(F.lit(1e27), 1).alias("large"), rounded(F.lit(-2.5e300), 2).alias("larger"), rounded(F.lit(1.25), 1).alias("tie"),
        rounded(F.lit(float("nan")), 1).alias("nan"), rounded(F.lit(None).cast("double"), 1).alias("none"), rounded(F.lit(1e-13), 3).alias("small")).first()
    assert tuple(row) == (1e27, -2.5e300, 1.3, None, None, 0.0)


def test_quantiles_count_few_values_of_large_groups(spark, monkeypatch):
    """An outlier, ties and infinities do not widen the brackets."""
    monkeypatch.setattr(quantiles, "FEW", 500)
    rng = np.random.default_rng(0)
    for spoiled in ([1e9], [float("inf")] * 3 + [float("-inf")] * 2, [0.5] * 15_000, [-1.7e308, 1.7e308]):
        values = np.append(rng.random(20_000), spoiled)
        df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
        got = exact_quantiles(df, ["g"], "v", {"q": 0.5, "low": 0.001, "high": 0.999}).first()
        want = np.sort(values)
        for name, p in (("q", 0.5), ("low", 0.001), ("high", 0.999)):
            at = (len(want) - 1) * p
            low, high = want[int(at)], want[int(np.ceil(at))]
            assert got[name] == pytest.approx(low if low == high else low + (high - low) * (at - int(at)), abs=1e-12)
        b = quantiles.brackets(df.select("g", F.col("v").alias("_v")), ["g"], [0.5]).first()["_b"][0]
        assert sum(b["lo"] <= v <= b["hi"] for v in set(values)) < 60


def test_quantiles_of_infinities(spark, monkeypatch):
    inf = float("inf")
    groups = {"a": [inf], "b": [1.0, inf], "c": [-inf, 1.0], "d": [-inf, inf], "e": [inf, inf, 1.0], "f": [float("nan"), None, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    out = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert (out["a"], out["b"], out["c"], out["e"], out["f"]) == (inf, inf, -inf, inf, 2.0) and np.isnan(out["d"])
    arrivals = spark.createDataFrame([("g", v, 10) for v in (1.0, inf, inf, 2.0) for _ in range(30)], "g string, v double, w bigint")
    monkeypatch.setattr(quantiles, "FEW", 20)
    assert exact_quantiles(arrivals, ["g"], "v", {"m": 0.5, "low": 0.1}, "w").first().asDict() == {"g": "g", "n": 1200, "m": inf, "low": 1.0}
