"""Normalizers, unions, deduplication and nested access over derived feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import EV, clock, events, r6, table
from urbanpulse.functions.nested import clean_lists, flatten
from urbanpulse.functions.times import epoch_seconds, folder_date, service_departure, snapshot_epoch
from urbanpulse.operators import normalize
from urbanpulse.operators.dedup import keep_last
from urbanpulse.operators.unify import align, unify
from urbanpulse.session import spread
from urbanpulse.sources.feeds import (
    JOURNEY,
    bike_document,
    bikes_from,
    flight_schema,
    flights_from,
    situation_records,
    trips_from,
)
from urbanpulse.sources.schemas import RAW
from urbanpulse.sources.sinks import files_by_date, merge_listings, not_processed
from urbanpulse.sources.snapshots import FOLDER_DATE, feed_of, latest_file

register = Register()

# Documents are written on one line: every indentation would be an event of the parser.
FLAT = {"indent": ""}


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def parsed_once(parser: Column, text: DataFrame) -> DataFrame:
    """Fields of a parsed document. The one-item explode keeps later filters from being pushed
    into the parser, which would parse every row once per filter."""
    return text.select(F.explode(F.array(parser)).alias("d")).select("d.*")


# ---- flights -----------------------------------------------------------------------------------

@register("""SELECT CAST(o_orderkey AS VARCHAR) AS uniqueID, o_orderpriority AS airline,
  strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate - INTERVAL 2 HOUR ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS scheduled,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN round((o_custkey + 7200) / 60.0, 6)
       ELSE round(o_custkey / 60.0, 6) END AS delay_minutes, 'avinor' AS source
FROM orders WHERE o_orderstatus <> 'X'""")
def flight_delay_minutes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    late = F.timestamp_seconds(F.unix_seconds("d") + F.col("o_custkey"))
    raw = o.select(
        F.col("o_orderpriority").alias("airline"), F.col("o_orderstatus").alias("airport"),
        # an offset other than Z for one status, to be brought to UTC
        F.concat(iso(F.col("d")), F.when(F.col("o_orderstatus") == "F", "+02:00").otherwise("Z")).alias("schedule_time"),
        F.lit("D").alias("arr_dep"),
        F.when(F.col("o_orderstatus") == "P", F.lit("soon")).otherwise(F.concat(iso(late), F.lit("Z"))).alias("status_time"),
        F.col("o_orderkey").cast("string").alias("uniqueID"))
    out = normalize.normalize_flights(raw)
    return out.select("uniqueID", "airline", clock(F.col("timestamp"), "scheduled"),
                      r6(F.col("delay_minutes"), "delay_minutes"), "source")


@register("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def keep_last_per_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type", "value", "ts")
    return keep_last(rows, ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@register(f"""WITH {EV} SELECT CASE WHEN k >= 90 THEN NULL ELSE 'u' || k END AS unique_id, strftime(ts, '%Y-%m-%d') AS day,
  max(event_id) AS event_id FROM ev GROUP BY ALL""")
def keep_last_null_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select(
        F.when(F.col("k") < 90, F.concat(F.lit("u"), F.col("k").cast("string"))).alias("unique_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    return keep_last(rows, ["unique_id", "day"], ["event_id"])


@register(f"""WITH {EV} SELECT event_type AS airline, user_id % 7 AS gate, CAST(count(*) AS BIGINT) AS n,
  CAST(count(CASE WHEN k % 5 <> 0 THEN 1 END) AS BIGINT) AS n_status, CAST(count(DISTINCT CASE WHEN k % 5 <> 0 THEN 'C' || k % 5 END) AS BIGINT) AS n_codes,
  min(event_id) AS first_id FROM ev GROUP BY ALL""")
def xml_flights(spark: SparkSession, sf: str) -> DataFrame:
    """Every event written as a flight element and parsed back with the declared schema."""
    coded = F.when(F.col("k") % 5 != 0, F.struct(
        F.concat(F.lit("C"), (F.col("k") % 5).cast("string")).alias("_code"), iso(F.col("ts")).alias("_time")))
    element = F.struct(
        F.col("event_id").cast("string").alias("_uniqueID"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("airline"),
        (F.col("user_id") % 7).cast("string").alias("gate"), F.lit(" ").alias("airport"), coded.alias("status"))
    text = events(spark, sf).select(F.to_xml(element, FLAT | {"rowTag": "flight"}).alias("x"))
    parsed = parsed_once(F.from_xml("x", flight_schema(), {"rowTag": "flight"}), text)
    flights = flights_from(parsed).where(F.col("airport").isNull())
    return flights.groupBy("airline", F.col("gate").cast("bigint").alias("gate")).agg(
        F.count(F.lit(1)).alias("n"), F.count("status").alias("n_status"), F.count_distinct("status_code").alias("n_codes"),
        F.min(F.col("uniqueID").cast("bigint")).alias("first_id"))


# ---- transit -----------------------------------------------------------------------------------

def lineitem_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Each line as a trip snapshot with three stop updates, some without a delay."""
    line = table(spark, sf, "lineitem")

    def stop(i: int) -> Column:
        arrival = (F.col("l_quantity") * (i + 1) - 60).cast("bigint")
        return F.struct(
            F.concat_ws(":", F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(str(i))).alias("stop_id"),
            F.when(F.col("l_linenumber") != i + 1, arrival).alias("arrival_delay"),
            F.when(F.col("l_discount") > 0, (F.col("l_discount") * 1000 - 40 * i).cast("bigint")).alias("departure_delay"))

    return line.select(
        F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_returnflag").alias("route_id"),
        F.when(F.col("l_linestatus") == "O", F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).otherwise(0).alias("timestamp"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("start_date"),
        F.when(F.col("l_linenumber") < 5, F.format_string("%d:%02d:30", F.col("l_suppkey") % 30, F.col("l_partkey") % 60)).alias("start_time"),
        F.array(stop(0), stop(1), stop(2)).alias("stop_time_updates"))


LINE_TRIPS = """lt AS (SELECT l_orderkey::VARCHAR AS trip_id, l_returnflag AS route_id,
  CASE WHEN l_linestatus = 'O' THEN epoch_us(l_shipdate) // 1000000 ELSE 0 END AS ts,
  strftime(l_shipdate, '%Y%m%d') AS start_date, epoch_us(date_trunc('day', l_shipdate)) // 1000000 AS midnight,
  CASE WHEN l_linenumber < 5 THEN printf('%d:%02d:30', l_suppkey % 30, l_partkey % 60) ELSE '' END AS start_time,
  CASE WHEN l_linenumber < 5 THEN (l_suppkey % 30) * 3600 + (l_partkey % 60) * 60 + 30 ELSE 0 END AS clock,
  greatest(CASE WHEN l_linenumber <> 1 THEN CAST(trunc(l_quantity - 60) AS BIGINT) ELSE 0 END,
           CASE WHEN l_linenumber <> 2 THEN CAST(trunc(l_quantity * 2 - 60) AS BIGINT) ELSE 0 END,
           CASE WHEN l_linenumber <> 3 THEN CAST(trunc(l_quantity * 3 - 60) AS BIGINT) ELSE 0 END) AS arr,
  CASE WHEN l_discount > 0 THEN CAST(trunc(l_discount * 1000) AS BIGINT) ELSE 0 END AS dep FROM lineitem)"""


@register(f"""WITH {LINE_TRIPS} SELECT trip_id, route_id, CASE WHEN ts = 0 THEN midnight + clock ELSE ts END AS timestamp,
  start_date, start_time, max(arr) AS max_arrival_delay_sec, max(dep) AS max_departure_delay_sec,
  midnight + clock AS departure_timestamp, CAST(3 * count(*) AS BIGINT) AS n_stop_updates
FROM lt GROUP BY trip_id, route_id, ts, start_date, start_time, midnight, clock""")
def trip_max_delay(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_trips(lineitem_trips(spark, sf))


@register(f"""WITH {LINE_TRIPS}, grouped AS (
  SELECT trip_id, route_id, CASE WHEN ts = 0 THEN midnight + clock ELSE ts END AS timestamp, midnight + clock AS departure,
    max(arr) AS arr, max(dep) AS dep FROM lt GROUP BY trip_id, route_id, ts, start_date, start_time, midnight, clock)
SELECT route_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(arr) AS BIGINT) AS arrival, CAST(sum(dep) AS BIGINT) AS departure_delay FROM (
  SELECT *, row_number() OVER (PARTITION BY trip_id, route_id, departure ORDER BY timestamp DESC, dep DESC, arr DESC) AS rn FROM grouped)
WHERE rn = 1 GROUP BY route_id""")
def trip_dedup(spark: SparkSession, sf: str) -> DataFrame:
    trips = normalize.normalize_trips(lineitem_trips(spark, sf))
    last = keep_last(trips, ["trip_id", "route_id", "departure_timestamp"],
                     ["timestamp", "max_departure_delay_sec", "max_arrival_delay_sec"])
    return last.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("max_arrival_delay_sec").alias("arrival"),
        F.sum("max_departure_delay_sec").alias("departure_delay"))


@register("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN epoch_us(date_trunc('day', o_orderdate)) // 1000000
  ELSE epoch_us(date_trunc('day', o_orderdate)) // 1000000 + (o_orderkey % 31) * 3600 + (o_custkey % 60) * 60 END AS departure
FROM orders""")
def service_time(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") != "F", F.format_string("%d:%02d:xx", F.col("o_orderkey") % 31, F.col("o_custkey") % 60)).otherwise("")
    return o.select("o_orderkey", service_departure(F.date_format("o_orderdate", "yyyyMMdd"), text).alias("departure"))


@register("SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS sec FROM orders")
def epoch_units(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    sec = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    raw = F.when(F.col("o_orderstatus") == "F", sec * 1000000 * 10).when(F.col("o_orderstatus") == "P", sec * 1000 * 10).otherwise(sec)
    # ten times later keeps old dates above the size limits of their unit
    unit = epoch_seconds(raw)
    return o.select("o_orderkey", F.when(F.col("o_orderstatus").isin("F", "P"), (unit / 10).cast("bigint")).otherwise(unit).alias("sec"))


@register("""SELECT event_type AS mode, CAST(sum(CASE WHEN user_id % 3 = 0 THEN epoch_us(date_trunc('day', ts)) // 1000000 ELSE epoch_us(ts) // 1000000 END) AS BIGINT) AS departure_sum,
  CAST(sum(CASE WHEN user_id % 2 = 0 THEN epoch_us(ts) // 1000000 + 5
    WHEN user_id % 3 = 0 THEN epoch_us(date_trunc('day', ts)) // 1000000 ELSE epoch_us(ts) // 1000000 END) AS BIGINT) AS timestamp_sum
FROM events GROUP BY event_type""")
def implausible_epochs(spark: SparkSession, sf: str) -> DataFrame:
    sec = F.unix_seconds("ts")
    rows = events(spark, sf).select(
        F.col("event_type").alias("mode"), F.unix_seconds(F.date_trunc("day", "ts")).alias("fallback"),
        F.when(F.col("user_id") % 3 != 0, sec).otherwise(F.lit(86400)).alias("departure_timestamp"),
        F.when(F.col("user_id") % 2 == 0, sec + 5).alias("timestamp"))
    filled = normalize.fill_epochs(rows, F.col("fallback"))
    return filled.groupBy("mode").agg(
        F.sum("departure_timestamp").alias("departure_sum"), F.sum("timestamp").alias("timestamp_sum"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 29 < 24 AND o_custkey % 70 < 60 THEN
  epoch_us(date_trunc('day', o_orderdate)) // 1000000 + (o_orderkey % 29) * 3600 + (o_custkey % 70) * 60 + 7 END AS epoch,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def snapshot_names(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    path = F.format_string("raw/2024-13-45/%s/R_trips_%02d%02d07.parquet", F.date_format("o_orderdate", "yyyy-MM-dd"),
                           F.col("o_orderkey") % 29, F.col("o_custkey") % 70)
    day = folder_date(path)
    return o.select("o_orderkey", snapshot_epoch(day, path).alias("epoch"), F.date_format(day, "yyyy-MM-dd").alias("day"))


@register(f"""WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (k < 10) AS BIGINT) AS n_zero, round(count(*) FILTER (k < 10) * 100.0 / count(*), 4) AS pct_zero
FROM ev GROUP BY ALL""")
def zero_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("k") < 10, 0).otherwise(F.unix_seconds("ts")).alias("timestamp"))
    return normalize.zero_timestamp_share(rows, ("day",))


@register("""SELECT route_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS arrival_delay, CAST(sum(d) AS BIGINT) AS departure_delay,
  min(start_date) AS first_date, max(start_time) AS last_time FROM (
  SELECT l_returnflag AS route_id, CAST(l_quantity AS BIGINT) AS a, CASE WHEN l_tax > 0 THEN -l_linenumber END AS d,
    strftime(l_shipdate, '%Y%m%d') AS start_date, printf('%02d:%02d:00', l_suppkey % 24, l_partkey % 60) AS start_time
  FROM lineitem WHERE l_linenumber < 7) GROUP BY route_id""")
def xml_journeys(spark: SparkSession, sf: str) -> DataFrame:
    """Every line written as an estimated journey and parsed back; lines without a trip id are dropped."""
    line = spread(table(spark, sf, "lineitem")).withColumn("d", F.timestamp_seconds(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + (F.col("l_suppkey") % 24) * 3600 + (F.col("l_partkey") % 60) * 60))

    def at(shift: Column) -> Column:
        return F.concat(iso(F.timestamp_seconds(F.unix_seconds("d") + shift.cast("bigint"))), F.lit("+00:00"))

    call = F.struct(
        F.col("l_suppkey").cast("string").alias("StopPointRef"), at(F.lit(0)).alias("AimedArrivalTime"),
        at(F.col("l_quantity")).alias("ExpectedArrivalTime"), at(F.lit(0)).alias("AimedDepartureTime"),
        F.when(F.col("l_tax") > 0, at(-F.col("l_linenumber"))).alias("ExpectedDepartureTime"))
    journey = F.struct(
        at(F.lit(0)).alias("RecordedAtTime"), F.col("l_returnflag").alias("LineRef"),
        F.struct(F.date_format("d", "yyyy-MM-dd").alias("DataFrameRef"),
                 F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).otherwise(" ").alias("DatedVehicleJourneyRef")
                 ).alias("FramedVehicleJourneyRef"),
        F.struct(F.array(call).alias("EstimatedCall")).alias("EstimatedCalls"))
    text = line.select(F.to_xml(journey, FLAT | {"rowTag": "EstimatedVehicleJourney"}).alias("x"))
    parsed = parsed_once(F.from_xml("x", JOURNEY, {"rowTag": "EstimatedVehicleJourney"}), text)
    update = F.col("stop_time_updates")[0]
    # digits as numbers: an aggregate of texts would sort all rows first
    first, last = F.min(F.col("start_date").cast("int")), F.max(F.translate("start_time", ":", "").cast("int"))
    return trips_from(parsed).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(update["arrival_delay"]).alias("arrival_delay"),
        F.sum(update["departure_delay"]).alias("departure_delay"), F.lpad(first.cast("string"), 8, "0").alias("first_date"),
        F.regexp_replace(F.lpad(last.cast("string"), 6, "0"), r"(\d\d)(\d\d)(\d\d)", "$1:$2:$3").alias("last_time"))


# ---- bikes -------------------------------------------------------------------------------------

def bike_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("station_id"), F.lit(True).alias("is_renting"), F.lit(True).alias("is_returning"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("last_reported"),
        F.col("l_quantity").cast("bigint").alias("num_bikes_available"), F.col("l_linenumber").cast("bigint").alias("num_docks_available"))


@register("""SELECT l_partkey::VARCHAR AS location, CAST(count(*) AS BIGINT) AS n, round(sum(p_size - CAST(l_quantity AS BIGINT)), 6) AS in_use,
  max(CAST(p_size AS BIGINT)) AS capacity FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY ALL""")
def bike_capacity(spark: SparkSession, sf: str) -> DataFrame:
    stations = table(spark, sf, "part").where(F.col("p_size") > 10).select(
        F.col("p_partkey").cast("string").alias("station_id"), F.col("p_size").cast("bigint").alias("capacity"))
    out = normalize.normalize_bikes(bike_rows(spark, sf), stations)
    return out.groupBy("location").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("metric_value"), "in_use"), F.max("capacity").alias("capacity"))


@register("""SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS minute, CAST(sum(l_linenumber) AS DOUBLE) AS in_use,
  CAST(0 AS BIGINT) AS n_capacity FROM lineitem GROUP BY ALL""")
def bikes_without_capacity(spark: SparkSession, sf: str) -> DataFrame:
    out = normalize.normalize_bikes(bike_rows(spark, sf))
    return out.groupBy(clock(F.date_trunc("minute", "timestamp"))).agg(
        F.sum("metric_value").alias("in_use"), F.count("capacity").alias("n_capacity"))


@register("""SELECT p_partkey::VARCHAR AS station_id, max(CAST(p_size AS BIGINT)) AS capacity FROM part GROUP BY ALL""")
def station_capacities(spark: SparkSession, sf: str) -> DataFrame:
    info = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("station_id"), F.col("p_size").cast("bigint").alias("capacity"),
        F.col("p_partkey").alias("_row"))
    return normalize.station_capacity(info)


@register(f"""WITH {EV} SELECT event_type AS station_id, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n,
  CAST(sum(CASE WHEN user_id % 2 = 0 THEN 2 * k + 1 ELSE k END) AS BIGINT) AS bikes,
  CAST(sum(CASE WHEN user_id % 2 = 0 THEN 2 * user_id ELSE user_id END) AS BIGINT) AS updated FROM ev GROUP BY event_type""")
def bike_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as bike documents: a two-station list for even users, a single record for the others."""
    one = F.struct(F.col("event_type").alias("station_id"), F.col("k").alias("num_bikes_available"))
    two = F.struct(F.col("event_type").alias("station_id"), (F.col("k") + 1).alias("num_bikes_available"))
    even = F.col("user_id") % 2 == 0
    text = events(spark, sf).select(F.when(even, F.to_json(F.struct(
        F.col("user_id").alias("last_updated"), F.struct(F.array(one, two).alias("stations")).alias("data")))
    ).otherwise(F.to_json(F.struct(F.col("user_id").alias("last_updated"), one.alias("data")))).alias("x"))
    rows = bikes_from(parsed_once(F.from_json("x", bike_document()), text))
    return rows.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_bikes_available").alias("bikes"), F.sum("last_updated").alias("updated"))


# ---- road weather, travel times, situations ----------------------------------------------------

@register("""SELECT l_shipmode_key AS location, CAST(count(*) AS BIGINT) AS n, round(sum(metric_value), 6) AS total,
  CAST(count(metric_value) AS BIGINT) AS n_metric FROM (
  SELECT l_suppkey::VARCHAR AS l_shipmode_key, CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber = 2 THEN l_tax
    WHEN l_linenumber = 4 THEN l_discount END AS metric_value FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4)) GROUP BY ALL""")
def coalesce_metrics(spark: SparkSession, sf: str) -> DataFrame:
    def only(line: int, c: str) -> Column:
        return F.when(F.col("l_linenumber") == line, F.col(c))

    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("location"), only(1, "l_quantity").alias("road_temperature"),
        only(2, "l_tax").alias("air_temperature"), only(3, "l_quantity").alias("wind_direction_bearing"),
        only(4, "l_discount").alias("dew_point_temperature"),
        *[F.lit(None).cast("double").alias(c) for c in ("precipitation_intensity", "wind_speed", "max_wind_speed", "relative_humidity")])
    return normalize.weather_values(rows).groupBy("location").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("metric_value"), "total"), F.count("metric_value").alias("n_metric"))


@register("""SELECT l_suppkey::VARCHAR AS location, metric_name, CAST(count(*) AS BIGINT) AS n, round(sum(road), 6) AS road_temperature,
  round(sum(wind), 6) AS wind_speed, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_time FROM (
  SELECT l_suppkey, l_shipdate, 'road' AS metric_name, CASE WHEN l_linenumber > 1 THEN l_quantity END AS road, NULL::DOUBLE AS wind FROM lineitem
  UNION ALL SELECT l_suppkey, l_shipdate, 'wind', NULL, CASE WHEN l_linenumber < 6 THEN l_tax END FROM lineitem)
WHERE road IS NOT NULL OR wind IS NOT NULL GROUP BY ALL""")
def road_weather_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Nested site documents with two quantities each; bad text and absent values are null."""
    kind = RAW["road_weather"]["ns10:physicalQuantity"].dataType.elementType
    line = table(spark, sf, "lineitem")

    def filled(dtype: T.DataType, path: tuple[str, ...], value: Column) -> Column:
        """A struct of the declared type with one leaf set and all else null."""
        if not path:
            return value
        return F.struct(*[
            (filled(f.dataType, path[1:], value) if f.name == path[0] else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in dtype.fields])

    def quantity(index: str, path: tuple[str, ...], value: Column) -> Column:
        inner = filled(kind["ns10:physicalQuantity"].dataType, ("ns10:basicData", *path), value)
        return F.struct(F.lit(index).alias("@index"), inner.alias("ns10:physicalQuantity"))

    road = quantity("road", normalize.WEATHER_PATHS["road_temperature"],
                    F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("string")).otherwise("abc"))
    wind = quantity("wind", normalize.WEATHER_PATHS["wind_speed"],
                    F.when(F.col("l_linenumber") < 6, F.col("l_tax").cast("string")).otherwise(""))
    raw = line.select(
        F.col("l_suppkey").cast("string").alias("ns10:measurementSiteReference.@id"),
        F.concat(iso(F.col("l_shipdate")), F.lit(".250Z")).alias("ns10:measurementTimeDefault.ns10:timeValue"),
        F.array(road, wind).alias("ns10:physicalQuantity"))
    out = normalize.normalize_road_weather(raw)
    return out.groupBy("location", "metric_name").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("road_temperature"), "road_temperature"), r6(F.sum("wind_speed"), "wind_speed"),
        clock(F.max("timestamp"), "last_time"))


@register(f"""WITH {EV} SELECT event_id, CASE WHEN k % 4 <> 0 THEN user_id::VARCHAR END AS location_id,
  CASE WHEN k % 4 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS period_start, CASE WHEN k % 4 <> 0 THEN value END AS seconds,
  CASE WHEN k % 4 <> 0 THEN event_type END AS traffic_status FROM ev""")
def travel_time_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Road sections as nested lists; an empty list still gives one row."""
    name = "ns2:messageContainer.ns2:payload.ns10:physicalQuantity"
    kind = RAW["travel_times"][name].dataType
    body = F.to_json(F.struct(
        F.struct(F.struct(F.col("user_id").cast("string").alias("@id")).alias("ns8:predefinedLocationReference")).alias("ns10:pertinentLocation"),
        F.struct(
            F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startOfPeriod")).alias("ns10:period")).alias("ns10:measurementOrCalculationTime"),
            F.struct(F.col("value").cast("string").alias("ns10:duration")).alias("ns10:freeFlowTravelTime"),
            F.struct(F.col("event_type").alias("ns10:trafficStatusValue")).alias("ns10:trafficStatus")).alias("ns10:basicData")))
    text = F.when(F.col("k") % 4 != 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise("[]")
    raw = events(spark, sf).select("event_id", F.from_json(text, kind).alias(name), F.col("event_id").alias("_row"))
    out = normalize.normalize_travel_times(raw)
    return out.select(F.col("_row").alias("event_id"), "location_id", clock(F.col("period_start"), "period_start"),
                      F.col("free_flow_travel_time_sec").alias("seconds"), "traffic_status")


@register(f"""WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute,
  CASE WHEN k % 10 = 0 THEN 'unknown' ELSE 'T' || k % 10 END AS situation_type, 'L' || user_id % 5 AS location_id,
  CAST(count(*) AS BIGINT) AS event_count, 'vegvesen' AS source FROM ev WHERE event_type = 'error' GROUP BY ALL""")
def situation_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where(F.col("event_type") == "error").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("x.situationRecordCreationTime"),
        F.when(F.col("k") % 10 != 0, F.concat(F.lit("T"), (F.col("k") % 10).cast("string"))).alias("x.situationType"),
        F.concat(F.lit("L"), (F.col("user_id") % 5).cast("string")).alias("x.locationReference.@id"))
    return normalize.normalize_situations(rows).withColumn("minute", clock(F.col("minute")))


@register(f"""WITH {EV} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, event_type AS situation_type,
  CAST(count(*) AS BIGINT) AS event_count, CAST(0 AS BIGINT) AS n_located FROM ev GROUP BY ALL""")
def situation_one_location(spark: SparkSession, sf: str) -> DataFrame:
    """A single location is not a key and is reported as null."""
    rows = events(spark, sf).select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("overallStartTime"),
        F.col("event_type").alias("reportType"), F.lit("one").alias("countyNumber"))
    out = normalize.normalize_situations(rows)
    return out.groupBy(clock(F.col("minute")), "situation_type").agg(
        F.sum("event_count").alias("event_count"), F.count("location_id").alias("n_located"))


@register("""SELECT l_returnflag AS severity, l_linestatus AS version, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 6) AS total
FROM lineitem GROUP BY ALL""")
def situation_record_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Situations with two records each: parent fields are copied down and the record's own wins."""
    line = table(spark, sf, "lineitem")
    record = F.struct(F.col("l_linestatus").alias("version"), (F.col("l_quantity") / 2).alias("amount"),
                      F.array(F.lit("a"), F.lit("b")).alias("lanes"))
    parents = line.select(F.col("l_returnflag").alias("severity"), F.lit("parent").alias("version"), F.array(record, record).alias("records"))
    flat = situation_records(parents, "records").where(F.col("lanes") == "a,b")
    return flat.groupBy("severity", "version").agg(
        (F.count(F.lit(1)) / 2).cast("bigint").alias("n"), r6(F.sum("amount"), "total"))


@register("""SELECT l_returnflag AS severity, l_linestatus AS version, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 6) AS total
FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL""")
def situation_lone_records(spark: SparkSession, sf: str) -> DataFrame:
    """Situations with a lone record instead of a list; those without any have no row."""
    line = table(spark, sf, "lineitem")
    record = F.when(F.col("l_linenumber") > 1, F.struct(F.col("l_linestatus").alias("version"), F.col("l_quantity").alias("amount")))
    parents = line.select(F.col("l_returnflag").alias("severity"), F.lit("parent").alias("version"), record.alias("records"))
    return situation_records(parents, "records").groupBy("severity", "version").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("amount"), "total"))


# ---- schemas, nesting, listings ----------------------------------------------------------------

@register("""SELECT kind, key, balance, nation FROM (
  SELECT 'customer' AS kind, c_custkey::VARCHAR AS key, c_acctbal AS balance, c_nationkey::VARCHAR AS nation FROM customer
  UNION ALL SELECT 'supplier', s_name, CAST(CAST(trunc(s_acctbal) AS BIGINT) AS DOUBLE), NULL FROM supplier)""")
def unify_widen(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("string").alias("nation"))
    s = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_name").alias("key"), F.col("s_acctbal").cast("bigint").alias("balance"), F.lit(None).alias("nation"))
    return unify([c, s], "widen")


@register("""SELECT c_custkey::VARCHAR AS key, CAST(c_nationkey AS DOUBLE) AS amount, NULL::VARCHAR AS gone FROM customer
  UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def unify_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("amount"), F.lit(None).alias("gone"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("amount"))
    return unify([c, s], "rank")


@register("""SELECT c_custkey AS key, c_acctbal AS balance FROM customer
  UNION ALL SELECT NULL, s_acctbal FROM supplier""")
def first_schema_align(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    return align([c, s])


@register(f"WITH {EV} SELECT k AS \"props.k\", event_type, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    parsed = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("props"))
    return flatten(parsed).groupBy(F.col("`props.k`"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT vec_id, label, (embedding[1] > 0)::VARCHAR || ',' || (embedding[2] > 0)::VARCHAR || ',None' AS signs FROM embeddings""")
def list_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    signs = F.array((F.col("embedding")[0] > 0).cast("string"), (F.col("embedding")[1] > 0).cast("string"), F.lit(None).cast("string"))
    nested = e.select("vec_id", "label", F.struct(signs.alias("signs")).alias("deep"))
    return flatten(clean_lists(nested)).withColumnRenamed("deep.signs", "signs")


def snapshot_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A file per event: half of them in a dated folder, the others dated by modification time."""
    dated = F.concat(F.lit("raw/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"))
    return events(spark, sf).select(
        F.col("event_type").alias("source"), "user_id",
        F.concat(F.when(F.col("k") % 2 == 0, dated).otherwise("raw/misc-04-12/"), F.col("event_type"), F.lit("_"),
                 F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".parquet")).alias("key"),
        F.when(F.col("k") % 2 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts")).alias("last_modified"))


LISTING = f"""{EV}, files AS (SELECT event_type AS source, user_id, CASE WHEN k % 2 = 0 THEN 'raw/' || strftime(ts, '%Y-%m-%d') || '/' ELSE 'raw/misc-04-12/' END
  || event_type || '_' || lpad(event_id::VARCHAR, 12, '0') || '.parquet' AS key, CASE WHEN k % 2 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts END AS last_modified, ts FROM ev)"""


@register(f"WITH {LISTING} SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(count(*) AS BIGINT) AS n_files, min(key) AS first_key, max(key) AS last_key FROM files GROUP BY ALL")
def files_per_date(spark: SparkSession, sf: str) -> DataFrame:
    return files_by_date(snapshot_listing(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(f"""WITH {LISTING} SELECT source, arg_max(key, strftime(last_modified, '%Y-%m-%d %H:%M:%S.%f') || key) AS key,
  strftime(max(last_modified), '%Y-%m-%d %H:%M:%S') AS last_modified FROM files GROUP BY source""")
def latest_files(spark: SparkSession, sf: str) -> DataFrame:
    return latest_file(snapshot_listing(spark, sf), ["source"]).withColumn("last_modified", clock(F.col("last_modified")))


@register(f"""WITH {LISTING}, ledger AS (SELECT key FROM files WHERE ts < TIMESTAMP '2024-01-20')
SELECT source, CAST(count(*) AS BIGINT) AS n_new, min(key) AS first_key FROM files WHERE key NOT IN (SELECT key FROM ledger) GROUP BY source""")
def incremental_files(spark: SparkSession, sf: str) -> DataFrame:
    files = snapshot_listing(spark, sf)
    done = events(spark, sf).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    ledger = files.join(done.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("_id")),
                        F.substring("key", -20, 12) == F.col("_id"), "left_semi")
    return not_processed(files, ledger).groupBy("source").agg(F.count(F.lit(1)).alias("n_new"), F.min("key").alias("first_key"))


@register(f"WITH {LISTING} SELECT source, CAST(count(*) AS BIGINT) AS n_files FROM (SELECT DISTINCT source, key FROM files WHERE source IN ('view', 'click')) GROUP BY source")
def merged_listings(spark: SparkSession, sf: str) -> DataFrame:
    files = snapshot_listing(spark, sf).select("source", "key")
    both = merge_listings(files.where(F.col("source").isin("view", "click")), files.where(F.col("source") == "click"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))


@register(f"""WITH {EV} SELECT CASE event_type WHEN 'view' THEN 'trips' WHEN 'click' THEN 'flights' WHEN 'error' THEN 'situations'
  WHEN 'signup' THEN 'road_weather' ELSE 'purchase' END AS feed, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL""")
def feed_names(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.create_map(*[F.lit(x) for x in ("view", "entur_siri_et_normalized_avinor", "click", "avinor_normalized_",
                                             "error", "vegvesen_traffic_situations_", "signup", "vegvesen_normalized_", "purchase", "other_")])
    named = events(spark, sf).select(feed_of(stem[F.col("event_type")], F.col("event_type")).alias("feed"))
    return named.groupBy("feed").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users
FROM events WHERE CAST(ts AS DATE) = CAST(date_trunc('day', ts + INTERVAL 30 MINUTE) AS DATE) GROUP BY ALL""")
def own_date_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose own date is that of the folder they were collected into half an hour later."""
    half_hour = F.timestamp_seconds(F.unix_micros("ts") / 1e6 + 1800)
    rows = events(spark, sf).withColumn(FOLDER_DATE, half_hour.cast("date"))
    kept = normalize.own_date_only(rows, "ts")
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


QUERIES, ORACLES = register.queries, register.oracles
