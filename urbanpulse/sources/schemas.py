"""Declared schemas of raw and normalized tables."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, WHOLE, REAL, FLAG, INSTANT = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(fields: dict) -> T.StructType:
    """Struct type from a dict of names to types; a nested dict is a nested struct."""
    return T.StructType([
        T.StructField(name, struct(kind) if isinstance(kind, dict) else kind) for name, kind in fields.items()
    ])


def each(names: str, kind: T.DataType = TEXT) -> dict:
    """Several fields of one type, names separated by blanks."""
    return {name: kind for name in names.split()}


def rows(fields: dict) -> T.ArrayType:
    return T.ArrayType(struct(fields))


_WEATHER_DATA = {
    "ns10:roadSurfaceConditionMeasurements": {"roadSurfaceTemperature": {"temperature": TEXT}},
    "ns10:temperature": {"airTemperature": {"temperature": TEXT}, "dewPointTemperature": {"temperature": TEXT}},
    "ns10:precipitationDetail": {"precipitationIntensity": {"millimetresPerHourIntensity": TEXT}},
    "ns10:wind": {
        "windSpeed": {"windSpeed": TEXT}, "windDirectionBearing": {"directionBearing": TEXT},
        "maximumWindSpeed": {"windSpeed": TEXT},
    },
    "ns10:humidity": {"relativeHumidity": {"percentage": TEXT}},
}
_TRAVEL_DATA = {
    "ns10:measurementOrCalculationTime": {"ns10:period": {"startOfPeriod": TEXT, "endOfPeriod": TEXT}},
    "ns10:freeFlowTravelTime": {"ns10:duration": TEXT},
    "ns10:freeFlowSpeed": {"speed": TEXT},
    "ns10:trafficStatus": {"ns10:trafficStatusValue": TEXT},
}
STOP_UPDATES = rows({
    "stop_id": TEXT, **each("arrival_delay departure_delay", WHOLE),
    **each("stop_point_name destination_display arrival_status departure_status"),
})

RAW = {
    "flights": struct(each(
        "airline flight_id airport schedule_time arr_dep status status_code status_time delayed uniqueID")),
    "trips": struct({
        **each("id type trip_id route_id"), "timestamp": WHOLE, **each("start_date start_time"),
        "stop_time_updates": STOP_UPDATES, **each("direction_ref operator_ref monitored data_source"),
    }),
    "bikes": struct({
        "station_id": TEXT, **each("is_installed is_renting is_returning", FLAG),
        **each("last_reported num_vehicles_available num_bikes_available num_docks_available last_updated", WHOLE),
    }),
    "bike_stations": struct({"station_id": TEXT, "capacity": WHOLE}),
    "vehicle_positions": struct({
        **each("id type trip_id"), **each("latitude longitude", REAL), "timestamp": WHOLE}),
    "alerts": struct(each("id type cause effect")),
    "stops": struct({"stop_id": TEXT, **each("stop_lat stop_lon", REAL)}),
    "road_weather": struct({
        "ns10:measurementSiteReference.@id": TEXT, "ns10:measurementTimeDefault.ns10:timeValue": TEXT,
        "ns10:physicalQuantity": rows({
            "@index": TEXT, "ns10:physicalQuantity": {"@xsi:type": TEXT, "ns10:basicData": _WEATHER_DATA}}),
    }),
    "travel_times": struct({
        "ns2:messageContainer.ns2:payload.ns10:physicalQuantity": rows({
            "ns10:pertinentLocation": {"ns8:predefinedLocationReference": {"@id": TEXT}},
            "ns10:basicData": _TRAVEL_DATA}),
    }),
}

NORMALIZED = {
    "flights": struct({
        **each("airline flight_id airport schedule_time location metric_value"), "timestamp": INSTANT,
        **each("metric_name source"), "status_time": INSTANT, "delayed": TEXT, "delay_minutes": REAL,
        "uniqueID": TEXT,
    }),
    "bikes": struct({
        "location": TEXT, "metric_value": REAL, **each("num_bikes_available num_docks_available", WHOLE),
        **each("is_renting is_returning", FLAG), "timestamp": INSTANT, "source": TEXT, "capacity": WHOLE,
        "is_installed": FLAG, "num_vehicles_available": WHOLE,
    }),
    "road_weather": struct({
        **each("location metric_name"), "metric_value": REAL, "timestamp": INSTANT, "source": TEXT,
        **each("road_temperature air_temperature precipitation_intensity wind_speed wind_direction_bearing "
               "max_wind_speed relative_humidity dew_point_temperature", REAL),
        "measurement_type": TEXT,
    }),
    "travel_times": struct({
        "location_id": TEXT, **each("period_start period_end", INSTANT),
        **each("free_flow_travel_time_sec free_flow_speed_kmh", REAL), **each("traffic_status source"),
    }),
    "situations": struct({
        "date": TEXT, "minute": INSTANT, **each("situation_type location_id"), "event_count": WHOLE, "source": TEXT,
    }),
    "trips": struct({
        **each("trip_id route_id"), "timestamp": WHOLE, **each("start_date start_time"),
        **each("max_arrival_delay_sec max_departure_delay_sec departure_timestamp", WHOLE),
    }),
}
