"""Parsers of the landed feed documents (XML, JSON, CSV) into raw tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.functions.nested import as_list, clean_lists, flatten
from urbanpulse.functions.times import iso_timestamp
from urbanpulse.session import path_exists, utc
from urbanpulse.sources.schemas import RAW, TEXT, WHOLE, each, rows, struct

# Child tags of a flight element; `status` carries attributes.
FLIGHT_TAGS = (
    "airline", "flight_id", "dom_int", "schedule_time", "arr_dep", "airport", "via_airport",
    "check_in", "gate", "belt_number", "delayed",
)
FLIGHT_STATUS_ATTRIBUTES = ("code", "time")

JOURNEY = struct({
    **each("RecordedAtTime LineRef DirectionRef OperatorRef Monitored DataSource"),
    "FramedVehicleJourneyRef": each("DataFrameRef DatedVehicleJourneyRef"),
    "EstimatedCalls": {"EstimatedCall": rows(each(
        "StopPointRef StopPointName DestinationDisplay AimedArrivalTime ExpectedArrivalTime ArrivalStatus "
        "AimedDepartureTime ExpectedDepartureTime DepartureStatus"))},
})


TRAVEL_TIMES = "ns2:messageContainer.ns2:payload.ns10:physicalQuantity"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def xml(spark: SparkSession, path: str | list[str], row_tag: str, schema: T.StructType,
        ignore_namespace: bool = True, attribute_prefix: str = "_") -> DataFrame:
    """XML rows with a declared schema: nothing is inferred and nothing is read twice."""
    return (
        utc(spark).read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", ignore_namespace)
        .option("attributePrefix", attribute_prefix).option("valueTag", "_VALUE").schema(schema).load(path)
    )


def flight_schema(tags: Iterable[str] = FLIGHT_TAGS) -> T.StructType:
    status = {"_VALUE": TEXT, **{f"_{a}": TEXT for a in FLIGHT_STATUS_ATTRIBUTES}}
    return struct({**{t: TEXT for t in tags}, "status": status, "_uniqueID": TEXT})


def flights_from(df: DataFrame) -> DataFrame:
    """Flight elements to all-text rows; a child's attribute becomes `tag_attribute`."""
    plain = [blank_to_null(F.col(t)).alias(t) for t in df.columns if t not in ("status", "_uniqueID")]
    code = F.col("status._code")
    return df.select(
        *plain,
        F.coalesce(code, blank_to_null(F.col("status._VALUE"))).alias("status"),
        code.alias("status_code"),
        F.col("status._time").alias("status_time"),
        F.col("_uniqueID").alias("uniqueID"),
    )


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    return flights_from(xml(spark, path, "flight", flight_schema()))


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airport names with a three-letter code."""
    names = xml(spark, path, "airportName", struct(each("_code _name")))
    return names.select(F.col("_code").alias("code"), F.col("_name").alias("name")).where(F.length("code") == 3)


def _delay(aimed: Column, expected: Column) -> Column:
    """Seconds late, whole seconds towards zero."""
    late = F.unix_micros(iso_timestamp(expected, fraction=True)) - F.unix_micros(iso_timestamp(aimed, fraction=True))
    return (late / F.lit(1e6)).cast("bigint")


def trips_from(journeys: DataFrame) -> DataFrame:
    """Estimated journeys to one row each with an array of stop updates; no trip id, no row."""
    calls = F.col("EstimatedCalls.EstimatedCall")

    def update(call: Column) -> Column:
        return F.struct(
            blank_to_null(call["StopPointRef"]).alias("stop_id"),
            _delay(call["AimedArrivalTime"], call["ExpectedArrivalTime"]).alias("arrival_delay"),
            _delay(call["AimedDepartureTime"], call["ExpectedDepartureTime"]).alias("departure_delay"),
            blank_to_null(call["StopPointName"]).alias("stop_point_name"),
            blank_to_null(call["DestinationDisplay"]).alias("destination_display"),
            blank_to_null(call["ArrivalStatus"]).alias("arrival_status"),
            blank_to_null(call["DepartureStatus"]).alias("departure_status"),
        )

    departures = F.filter(
        F.transform(calls, lambda c: blank_to_null(c["AimedDepartureTime"])), lambda t: t.isNotNull()
    )
    # the clock and date are the local parts of the text, as written
    first = F.get(departures, F.lit(0))
    frame = blank_to_null(F.col("FramedVehicleJourneyRef.DataFrameRef"))
    trip = blank_to_null(F.col("FramedVehicleJourneyRef.DatedVehicleJourneyRef"))
    return journeys.select(
        trip.alias("id"),
        F.lit("siri_et").alias("type"),
        trip.alias("trip_id"),
        blank_to_null(F.col("LineRef")).alias("route_id"),
        F.unix_seconds(iso_timestamp(blank_to_null(F.col("RecordedAtTime")), fraction=True)).alias("timestamp"),
        F.nullif(F.regexp_replace(F.regexp_extract(frame, r"^(\d{4}-\d{2}-\d{2})", 1), "-", ""), F.lit(""))
        .alias("start_date"),
        F.nullif(F.regexp_extract(first, r"T(\d{2}:\d{2}:\d{2})", 1), F.lit("")).alias("start_time"),
        F.coalesce(F.transform(calls, update), F.array().cast(RAW["trips"]["stop_time_updates"].dataType))
        .alias("stop_time_updates"),
        blank_to_null(F.col("DirectionRef")).alias("direction_ref"),
        blank_to_null(F.col("OperatorRef")).alias("operator_ref"),
        blank_to_null(F.col("Monitored")).alias("monitored"),
        blank_to_null(F.col("DataSource")).alias("data_source"),
    ).where(F.col("trip_id").isNotNull())


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return trips_from(xml(spark, path, "EstimatedVehicleJourney", JOURNEY))


def read_vehicle_positions(spark: SparkSession, path: str) -> DataFrame:
    """Landed vehicle rows (JSON); other entity types are left out."""
    return spark.read.schema(RAW["vehicle_positions"]).json(path).where(F.col("type") == "vehicle_position")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW["alerts"]).json(path).where(F.col("type") == "alert")


def bike_document(station: T.StructType = RAW["bikes"]) -> T.StructType:
    """A bike document: a station list under `data`, one record under `data`, or one record alone."""
    own = {f.name: f.dataType for f in station.fields}
    return struct({**own, "last_updated": WHOLE, "data": {"stations": T.ArrayType(station), **own}})


def bikes_from(documents: DataFrame, station: T.StructType = RAW["bikes"]) -> DataFrame:
    """Rows of bike documents: one per listed station, else one for the record; all carry `last_updated`."""
    names = [n for n in station.fieldNames() if n != "last_updated"]

    def record(prefix: str):
        return F.array(F.struct(*[F.col(prefix + n).alias(n) for n in names]))

    listed = F.transform("data.stations", lambda s: F.struct(*[s[n].alias(n) for n in names]))
    found = F.coalesce(listed, F.when(F.col("data").isNotNull(), record("data.")), record(""))
    return documents.select(F.explode(found).alias("s"), "last_updated").select("s.*", "last_updated")


def read_bike_feed(spark: SparkSession, path: str, station: T.StructType = RAW["bikes"]) -> DataFrame:
    documents = utc(spark).read.schema(bike_document(station)).option("multiLine", True).json(path)
    return bikes_from(documents, station)


def read_document(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON document (or a folder of them, one a line); a missing one gives an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).option("ignoreMissingFiles", True).json(path)


def situation_records(situations: DataFrame, records: str) -> DataFrame:
    """One flat row per record of a situation: parent fields are copied down, a record's own field wins.

    The record column may be a list or a lone record, which counts as a list of one.
    """
    kind = situations.schema[records].dataType
    child = kind.elementType if isinstance(kind, T.ArrayType) else kind
    own = set(child.fieldNames())
    parents = [F.col(f"`{c}`") for c in situations.columns if c != records and c not in own]
    exploded = situations.select(*parents, F.explode(as_list(F.col(f"`{records}`"), kind)).alias("_record"))
    flat = exploded.select(*parents, *[F.col("_record").getField(n).alias(n) for n in child.fieldNames()])
    return flatten(clean_lists(flat))


def read_situations(spark: SparkSession, path: str, schema: T.StructType,
                    row_tag: str = "ns12:situation", records: str = "ns12:situationRecord") -> DataFrame:
    found = xml(spark, path, row_tag, schema, ignore_namespace=False, attribute_prefix="@")
    return situation_records(found, records)


def site_measurement_schema() -> T.StructType:
    """Nested form of the road-weather document: its dotted raw columns are struct paths."""
    quantity = RAW["road_weather"]["ns10:physicalQuantity"].dataType
    return struct({
        "ns10:measurementSiteReference": {"@id": TEXT},
        "ns10:measurementTimeDefault": {"ns10:timeValue": TEXT},
        "ns10:physicalQuantity": quantity,
    })


def road_weather_from(sites: DataFrame) -> DataFrame:
    """Site measurements with their nested names joined by dots."""
    return flatten(sites)


def read_road_weather(spark: SparkSession, path: str) -> DataFrame:
    """Site measurements, one row per site, nested names joined by dots."""
    return road_weather_from(xml(spark, path, "ns10:siteMeasurements", site_measurement_schema(), False, "@"))


def read_weather_sites(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Measurement-site reference table."""
    found = xml(spark, path, "ns10:measurementSite", schema, False, "@")
    return flatten(clean_lists(found))


def travel_time_schema() -> T.StructType:
    return struct({"ns10:physicalQuantity": RAW["travel_times"][TRAVEL_TIMES].dataType})


def travel_times_from(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("`ns10:physicalQuantity`").alias(TRAVEL_TIMES))


def read_travel_times(spark: SparkSession, path: str) -> DataFrame:
    """The whole travel-time document as one row that holds the list of quantities."""
    return travel_times_from(xml(spark, path, "ns2:payload", travel_time_schema(), False, "@"))


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    """Stop register; stops without coordinates are left out."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        "stop_id", F.col("stop_lat").try_cast("double").alias("stop_lat"),
        F.col("stop_lon").try_cast("double").alias("stop_lon"),
    ).where(F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull())
