"""Command line, for spark-submit: normalize, compact, analyze, cities, zones, health, inspect."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from urbanpulse.fixed import PERIOD_SETS, Period
from urbanpulse.operators.periods import day_end, window_bounds
from urbanpulse.plans.impact import analyse_table, summary_row
from urbanpulse.plans.normalization import FEEDS, compact_feed, normalize_all, sweep_feed
from urbanpulse.plans.stored import city_report, feed_health, zone_report
from urbanpulse.session import utc
from urbanpulse.sources.sinks import append_csv
from urbanpulse.sources.snapshots import profile, read_normalized_table


def hours(text: str) -> tuple[int, int]:
    first, last = (int(part) for part in text.split("-"))
    if not 0 <= first < last <= 24:
        raise argparse.ArgumentTypeError("hours must be FIRST-LAST within 0-24")
    return first, last


def day_start(text: str) -> datetime:
    moment = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="urbanpulse")
    commands = top.add_subparsers(dest="command", required=True)
    n = commands.add_parser("normalize", help="bring new raw snapshots into the normalized tables")
    n.add_argument("--raw", required=True)
    n.add_argument("--out", required=True)
    n.add_argument("--ledger", required=True)
    n.add_argument("--start-date")
    n.add_argument("--end-date")
    n.add_argument("--all", action="store_true", help="all dates instead of today")
    n.add_argument("--re-run-all", action="store_true", help="take all files again and replace what their dates hold")
    n.add_argument("--only-trips", action="store_true", help="transit delays only")
    c = commands.add_parser("compact", help="pack small files of the normalized tables and remove what no longer counts")
    c.add_argument("--tables", required=True)
    c.add_argument("--ledger", required=True)
    c.add_argument("--target-mb", type=int, default=128)
    c.add_argument("--keep-versions", type=int, default=10)
    a = commands.add_parser("analyze", help="weather impact for one window or a set of periods")
    a.add_argument("--tables", required=True)
    a.add_argument("--mode", choices=("single", "compare"), default="single")
    a.add_argument("--periods", choices=sorted(PERIOD_SETS), default="three_phases")
    a.add_argument("--period-days", type=int)
    a.add_argument("--start-date", type=day_start)
    a.add_argument("--end-date", type=day_end)
    a.add_argument("--weekday-only", action="store_true")
    a.add_argument("--weekend-only", action="store_true")
    a.add_argument("--part-of-day", type=hours)
    a.add_argument("--output-dir")
    a.add_argument("--summary-csv")
    reports = {
        "cities": "zone metrics and Moran's I of all cities", "zones": "clustered stop zones against temperature",
        "health": "gaps, throughput and latency of the feeds"}
    for name, text in reports.items():
        r = commands.add_parser(name, help=text)
        r.add_argument("--raw", required=True)
        r.add_argument("--periods", choices=sorted(PERIOD_SETS), default="wa1_wa2_wb_wc")
        r.add_argument("--output-dir", required=True)
        if name != "health":
            r.add_argument("--stops", required=True, help="stop register (CSV)")
        if name == "zones":
            r.add_argument("--tables", required=True)
    i = commands.add_parser("inspect", help="profile the normalized tables")
    i.add_argument("--tables", required=True)
    return top


def periods_of(args: argparse.Namespace) -> Sequence[Period]:
    if args.mode == "compare":
        return PERIOD_SETS[args.periods]
    start, end = window_bounds(args.start_date, args.end_date, args.period_days)
    return (Period("window", start, end, args.weekday_only, args.weekend_only),)


def save(tables: dict[str, DataFrame | None], folder: str) -> None:
    """Every result table as Parquet under its own name."""
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = utc(SparkSession.builder.appName("urbanpulse").getOrCreate())
    if args.command == "normalize":
        done = normalize_all(spark, args.raw, args.out, args.ledger, args.start_date, args.end_date,
                             args.re_run_all, args.all, args.only_trips)
        for feed, files in done.items():
            print(f"{feed}: {files.read} files" + f", {files.unread} unread" * (files.unread > 0))
    elif args.command == "compact":
        for feed in FEEDS:
            dates = compact_feed(spark, args.tables, feed, args.target_mb << 20)
            gone = sweep_feed(spark, args.tables, args.ledger, feed, args.keep_versions)
            print(f"{feed}: {len(dates)} dates packed, {gone} old parts removed")
    elif args.command == "cities":
        save(city_report(spark, args.raw, args.stops, PERIOD_SETS[args.periods]), args.output_dir)
    elif args.command == "zones":
        save(zone_report(spark, args.raw, args.tables, args.stops, PERIOD_SETS[args.periods]), args.output_dir)
    elif args.command == "health":
        save(feed_health(spark, args.raw, PERIOD_SETS[args.periods]), args.output_dir)
    elif args.command == "inspect":
        for feed in FEEDS:
            print(feed)
            profile(read_normalized_table(spark, args.tables, feed), feed).show(truncate=False)
    else:
        impact = analyse_table(spark, args.tables, periods_of(args), hours=args.part_of_day)
        impact.status.show(truncate=False)
        impact.interpretation.show(truncate=False)
        if args.summary_csv:
            label = "{}-{}".format(*args.part_of_day) if args.part_of_day else ""
            append_csv(summary_row(impact.correlations, hours=label), args.summary_csv)
        if args.output_dir:
            save(vars(impact), args.output_dir)


if __name__ == "__main__":
    main()
