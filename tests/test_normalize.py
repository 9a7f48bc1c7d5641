"""Normalizer rules on literal rows."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.functions import nested, times
from urbanpulse.operators import normalize
from urbanpulse.operators.dedup import latest_flights, latest_trips
from urbanpulse.operators.unify import align, unify
from urbanpulse.sources.schemas import NORMALIZED, RAW
from urbanpulse.sources.snapshots import FILE, FILE_TIME, FOLDER_DATE, ROW

AT = datetime(2026, 1, 31)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def shape(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_flight_delay_and_bad_times(spark):
    rows = [("A", "2026-01-31T10:00:00Z", "2026-01-31T10:07:30Z"), ("B", "2026-01-31T10:00:00Z", None),
            ("C", "not-a-time", "2026-01-31T10:07:30Z"), ("D", "2026-01-31T12:00:00+02:00", "2026-01-31T10:00:00+0000"),
            ("E", "2026-01-31T10:00:00", None)]
    raw = spark.createDataFrame(rows, "airport string, schedule_time string, status_time string")
    out = {r["airport"]: r for r in normalize.normalize_flights(raw).collect()}
    assert out["A"]["delay_minutes"] == 7.5
    assert out["B"]["delay_minutes"] is None
    assert out["C"]["timestamp"] is None and out["C"]["delay_minutes"] is None
    assert out["D"]["delay_minutes"] == 0.0
    assert out["E"]["timestamp"] is None
    assert shape(normalize.normalize_flights(raw).schema) == shape(NORMALIZED["flights"])


def flights_with_files(spark, rows):
    schema = f"uniqueID string, status string, {FILE} string, {FILE_TIME} timestamp, {ROW} bigint, {FOLDER_DATE} date"
    return spark.createDataFrame(rows, schema)


def test_latest_flight_per_folder_date(spark):
    day, other = AT.date(), datetime(2026, 2, 1).date()
    rows = [("u1", "old", "b", datetime(2026, 1, 31, 1), 0, day), ("u1", "new", "a", datetime(2026, 1, 31, 2), 0, day),
            ("u1", "next day", "a", datetime(2026, 1, 31, 1), 0, other),
            (None, "x", "a", datetime(2026, 1, 31, 2), 1, day), (None, "y", "a", datetime(2026, 1, 31, 2), 2, day)]
    out = latest_flights(flights_with_files(spark, rows))
    assert sorted(r["status"] for r in out.collect()) == ["new", "next day", "y"]
    assert latest_flights(out).count() == out.count()


def trips(spark, rows, updates="array<struct<stop_id:string,arrival_delay:bigint,departure_delay:bigint>>"):
    return spark.createDataFrame(rows, f"trip_id string, route_id string, timestamp bigint, start_date string, start_time string, stop_time_updates {updates}")


def test_trip_delays(spark):
    def stops(*delays):
        return [("s", d, d) for d in delays]

    rows = [("a", "r", 1, "20260131", "10:00:00", stops(30, None, -10)), ("b", "r", 1, "20260131", "10:00:00", stops(-20, -5)),
            ("c", "r", 1, "20260131", "10:00:00", stops(-20, None)), ("d", "r", 1, "20260131", "10:00:00", []),
            ("e", "r", 1, "20260131", "10:00:00", None)]
    out = {r["trip_id"]: r for r in normalize.trip_delays(trips(spark, rows)).collect()}
    assert {k: r["max_arrival_delay_sec"] for k, r in out.items()} == {"a": 30, "b": -5, "c": 0, "d": 0, "e": 0}
    assert out["d"]["n_stop_updates"] == 0 and out["a"]["n_stop_updates"] == 3


def test_trip_without_delay_fields(spark):
    rows = [("a", "r", 1, "20260131", "10:00:00", [("s",)])]
    out = one(normalize.trip_delays(trips(spark, rows, "array<struct<stop_id:string>>")))
    assert out["max_arrival_delay_sec"] == 0 and out["max_departure_delay_sec"] == 0


def epoch(*parts):
    return int((datetime(*parts) - datetime(1970, 1, 1)).total_seconds())


def test_service_times(spark):
    def departure(day, clock, tz=None):
        return value(spark, times.service_departure(F.lit(day), F.lit(clock).cast("string"), tz))

    assert departure("20260131", "25:10:00") == epoch(2026, 2, 1, 1, 10)
    assert departure("20260131", "") == epoch(2026, 1, 31)
    assert departure("20260131", None) == epoch(2026, 1, 31)
    assert departure("20260131", "7:05") == epoch(2026, 1, 31, 7, 5)
    assert departure("nonsense", "10:00:00") is None
    assert departure("20260131", "10:00:00", "Europe/Oslo") == epoch(2026, 1, 31, 9)


def test_zero_timestamp_takes_departure(spark):
    out = one(normalize.trip_times(trips(spark, [("a", "r", 0, "20260131", "10:00:00", [])])))
    assert out["timestamp"] == out["departure_timestamp"] == epoch(2026, 1, 31, 10)


def test_snapshot_epoch_and_fallback(spark):
    schema = f"trip_id string, route_id string, timestamp bigint, start_date string, start_time string, stop_time_updates array<struct<arrival_delay:bigint>>, {FILE} string, {FILE_TIME} timestamp, {FOLDER_DATE} date"
    rows = [("a", "r", 0, None, None, [], "x/2026-01-31/RUT_trip-updates_132528.parquet", AT, AT.date()),
            ("b", "r", 0, None, None, [], "x/2026-01-31/X_996000.parquet", AT, AT.date()),
            ("c", "r", 1769850000, "20260131", "10:00:00", [], "x/2026-01-31/X_996000.parquet", AT, AT.date())]
    out = {r["trip_id"]: r for r in normalize.normalize_trips(spark.createDataFrame(rows, schema)).collect()}
    assert out["a"]["timestamp"] == out["a"]["departure_timestamp"] == epoch(2026, 1, 31, 13, 25, 28)
    assert out["b"]["timestamp"] == out["b"]["departure_timestamp"] == epoch(2026, 1, 31)
    assert out["c"]["timestamp"] == 1769850000 and out["c"]["departure_timestamp"] == epoch(2026, 1, 31, 10)


def test_latest_trip_by_file_name(spark):
    schema = f"trip_id string, route_id string, timestamp bigint, departure_timestamp bigint, max_departure_delay_sec bigint, max_arrival_delay_sec bigint, {FILE} string, {FOLDER_DATE} date"
    rows = [("t", "r", 9, 5, 1, 1, "a", AT.date()), ("t", "r", 3, 5, 2, 2, "b", AT.date()), ("t", None, 3, 5, 3, 3, "a", AT.date())]
    out = latest_trips(spark.createDataFrame(rows, schema))
    assert sorted(r["max_departure_delay_sec"] for r in out.collect()) == [2, 3]


def bikes(spark):
    return spark.createDataFrame(
        [("1", True, True, 1769850000, 8, 5), ("2", True, True, 1769850000, 8, 5)],
        "station_id string, is_renting boolean, is_returning boolean, last_reported bigint, num_bikes_available bigint, num_docks_available bigint")


def test_bikes(spark):
    stations = spark.createDataFrame([("1", 20)], RAW["bike_stations"])
    out = {r["location"]: r for r in normalize.normalize_bikes(bikes(spark), stations).collect()}
    assert out["1"]["metric_value"] == 12.0 and out["1"]["capacity"] == 20
    assert out["2"]["metric_value"] is None and out["2"]["capacity"] is None
    plain = normalize.normalize_bikes(bikes(spark))
    assert shape(plain.schema) == shape(NORMALIZED["bikes"])
    assert {r["metric_value"] for r in plain.collect()} == {5.0} and {r["capacity"] for r in plain.collect()} == {None}


def weather_raw(spark, basics):
    kind = RAW["road_weather"]["ns10:physicalQuantity"].dataType.elementType["ns10:physicalQuantity"].dataType["ns10:basicData"].dataType
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(basics)], "i int, b string")
    data = F.from_json("b", kind)
    item = F.struct(F.col("i").cast("string").alias("@index"), F.struct(F.lit("t").alias("@xsi:type"), data.alias("ns10:basicData")).alias("ns10:physicalQuantity"))
    return rows.select(F.lit("site").alias("ns10:measurementSiteReference.@id"), F.lit("2026-01-31T10:00:00.500+01:00").alias("ns10:measurementTimeDefault.ns10:timeValue"),
                       F.array(item).alias("ns10:physicalQuantity"))


def test_road_weather(spark):
    basics = ['{"ns10:wind":{"windDirectionBearing":{"directionBearing":"90"}}}', '{"ns10:humidity":{"relativeHumidity":{"percentage":"abc"}}}',
              "{}", '{"ns10:temperature":{"airTemperature":{"temperature":"-3.5"},"dewPointTemperature":{"temperature":"-9"}}}']
    out = normalize.normalize_road_weather(weather_raw(spark, basics))
    assert shape(out.schema) == shape(NORMALIZED["road_weather"])
    rows = {r["metric_name"]: r for r in out.collect()}
    assert set(rows) == {"0", "3"}
    assert rows["0"]["metric_value"] is None and rows["0"]["wind_direction_bearing"] == 90.0
    assert rows["3"]["metric_value"] == -3.5 and rows["3"]["timestamp"] == datetime(2026, 1, 31, 9, 0, 0, 500000)
    assert normalize.normalize_road_weather(spark.range(1)).count() == 0


def test_partial_weather_schema(spark):
    """Files that lack a branch of the nested data still normalize."""
    raw = spark.createDataFrame([], T.StructType.fromDDL(
        "`ns10:measurementTimeDefault.ns10:timeValue` string, `ns10:physicalQuantity` array<struct<`@index`:string,`ns10:physicalQuantity`:struct<`ns10:basicData`:struct<a:string>>>>"))
    assert normalize.normalize_road_weather(raw).columns == NORMALIZED["road_weather"].fieldNames()


def test_travel_times_schema(spark):
    raw = spark.createDataFrame([([],)], RAW["travel_times"])
    out = normalize.normalize_travel_times(raw)
    assert shape(out.schema) == shape(NORMALIZED["travel_times"]) and out.count() == 1


def test_situations(spark):
    raw = spark.createDataFrame(
        [("2026-01-31T10:00:59Z", "2026-01-31T11:00:00Z", None, "one"), ("2026-01-31T10:00:01Z", None, "roadwork", "one")],
        "`y.creationTime` string, `x.overallStartTime` string, situationType string, countyNumber string")
    out = {r["situation_type"]: r for r in normalize.normalize_situations(raw).collect()}
    assert set(out) == {"unknown", "roadwork"}
    assert out["unknown"]["minute"] == datetime(2026, 1, 31, 10) and out["unknown"]["location_id"] is None
    assert out["unknown"]["date"] == "2026-01-31"
    two = raw.withColumn("countyNumber", F.col("situationType"))
    assert {r["location_id"] for r in normalize.normalize_situations(two).collect()} == {"", "roadwork"}
    assert normalize.normalize_situations(raw.select("situationType")).count() == 0


def test_situations_counted_again_per_snapshot(spark):
    rows = [("2026-01-31T10:00:00Z", "t", "a", f) for f in ("f1", "f2")]
    raw = spark.createDataFrame(rows, f"creationTime string, situationType string, locationId string, {FILE} string")
    assert normalize.normalize_situations(raw).agg(F.sum("event_count")).first()[0] == 2
    assert normalize.normalize_situations(raw, dedup_snapshots=True).agg(F.sum("event_count")).first()[0] == 1


def test_column_resolver():
    names = ["a.Id", "x.overallStartTime", "y.creationTime", "reportType", "p.@id", "q.locationReference.@id"]
    found = normalize.situation_columns(names)
    assert found == {"time": "y.creationTime", "type": "reportType", "location": "q.locationReference.@id"}
    # without a stop word in the name the last hit of a needle wins
    assert nested.last_match(["a.@id", "b.@id"], ("@id",), ("location",)) == "b.@id"
    assert nested.last_match(["location.@id", "b.@id"], ("@id",), ("location",)) == "location.@id"


def test_epoch_units(spark):
    for raw in ("1769850000", "1769850000000", "1769850000000000"):
        assert value(spark, times.epoch_seconds(F.lit(raw))) == 1769850000
    assert value(spark, times.epoch_seconds(F.lit("x"))) is None


def test_folder_date(spark):
    def day(path):
        return str(value(spark, times.folder_date(F.lit(path), F.lit(AT))))

    assert day("a/2026-02-03/f.parquet") == "2026-02-03"
    assert day("a/2026-13-45/2026-02-03/f") == "2026-02-03"
    assert day("a/misc/f.parquet") == "2026-01-31"


def test_peak_flag(spark):
    def peak(*parts):
        return value(spark, times.is_peak(F.lit(datetime(*parts))))

    assert peak(2026, 1, 30, 9, 59) and not peak(2026, 1, 30, 10) and not peak(2026, 1, 31, 8)
    assert peak(2026, 1, 30, 15) and not peak(2026, 1, 30, 18)


def test_unify_rules(spark):
    a = spark.createDataFrame([(1, 2, None)], "k bigint, n int, gone void")
    b = spark.createDataFrame([("x", 2.5)], "k string, n double")
    out = unify([a, b], "rank")
    assert out.schema.simpleString() == "struct<k:string,n:double,gone:string>"
    assert {r["k"] for r in out.collect()} == {"1", "x"}
    first = align([a.select("k"), b])
    assert first.columns == ["k"] and {r["k"] for r in first.collect()} == {1, None}
    assert unify([b, a], "widen").schema["n"].dataType == T.DoubleType()


def test_flatten_and_lists(spark):
    df = spark.range(1).select(
        F.struct(F.array(F.lit("a"), F.lit(None)).alias("l"), F.struct(F.lit(1).alias("x")).alias("s")).alias("top"),
        F.array(F.struct(F.array(F.lit(1), F.lit(2)).alias("m"))).alias("deep"))
    out = nested.flatten(nested.clean_lists(df))
    row = one(out)
    assert out.columns == ["top.l", "top.s.x", "deep"]
    assert row["top.l"] == "a,None" and row["deep"][0]["m"] == "1,2"
    lone = spark.range(1).select(nested.as_list(F.lit("x"), T.StringType()).alias("a"), nested.as_list(F.lit(None).cast("string"), T.StringType()).alias("b"))
    assert one(lone)["a"] == ["x"] and one(lone)["b"] == []
