"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query runs whole, its result going to a sink that keeps nothing. One untimed query
starts the engine first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from urbanpulse import catalog
from urbanpulse.session import local_session

HEADLINE = (
    "minute_activity", "hourly_fact", "minute_fact_table", "period_fact_table", "multimodal_index", "period_compare",
    "corr_by_zone", "delay_robustness", "peak_offpeak_welch", "ols_weather", "keep_last_per_day", "flight_delay_minutes",
    "trip_max_delay", "trip_dedup", "bike_capacity", "road_weather_quantities", "situation_counts", "xml_journeys",
    "zone_activity", "morans_i", "moran_significance", "price_quantiles", "zscore_impute", "iforest_scores", "gap_stats",
    "latency_stats", "stream_minute_counts",
)


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    run(queries["window_filter"], spark, folder)
    times = {name: run(queries[name], spark, folder) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
