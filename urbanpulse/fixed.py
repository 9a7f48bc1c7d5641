"""Constants, patterns and lookup tables that results depend on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

# Clock and epoch limits.
PEAK_HOURS = (7, 8, 9, 15, 16, 17)
MIN_PLAUSIBLE_EPOCH = 946684800
MAX_PLAUSIBLE_EPOCH = 4102444800
MICROSECOND_EPOCH_ABOVE = 1e15
MILLISECOND_EPOCH_ABOVE = 1e12

# Weather.
TEMPERATURE_LIMITS = (-50.0, 50.0)
OPTIONAL_WEATHER = (
    "air_temperature",
    "precipitation_intensity",
    "wind_speed",
    "max_wind_speed",
    "relative_humidity",
)
METRIC_VALUE_ORDER = (
    "road_temperature",
    "air_temperature",
    "precipitation_intensity",
    "wind_speed",
    "max_wind_speed",
    "relative_humidity",
    "dew_point_temperature",
)

# Statistics.
NORMAL_95 = 1.96
MIN_REGRESSION_ROWS = 11
MIN_PEARSON_ROWS = 4
TRIVIAL_RATIO_BAND = 0.02
TRIVIAL_P = 0.05
WINSOR_TAILS = (0.01, 0.99)

# Interpretation texts, chosen by threshold on a correlation.
INSUFFICIENT = "Insufficient data for analysis."
INTERPRETATION = {
    "bikes": {
        "below": (-0.3, "Negative correlation suggests reduced bike usage during cold conditions."),
        "otherwise": "Weak or no clear relationship detected.",
        "missing": INSUFFICIENT,
    },
    "public_transport": {
        "below": (-0.3, "Negative correlation may indicate reduced service or mobility under bad weather."),
        "otherwise": "Public transport appears resilient to temperature changes.",
        "missing": INSUFFICIENT,
    },
    "flight_activity": {
        "above": (0.3, "Positive correlation indicates increased activity during colder conditions."),
        "otherwise": "No strong temperature impact on flight activity detected.",
        "missing": INSUFFICIENT,
    },
    "multimodal": {
        "above": (0.2, "Positive: higher temperature associated with higher combined (bike+PT+flight) activity."),
        "below": (-0.2, "Negative: colder conditions associated with higher combined activity."),
        "otherwise": "Weak linear relationship between temperature and combined multimodal activity.",
        "missing": "Insufficient data for multimodal index.",
    },
    "delay": {
        "above": (0.2, "Positive: higher temperature associated with higher mean delay (worse conditions)."),
        "below": (-0.2, "Negative: colder conditions associated with higher delay."),
        "otherwise": "Weak linear relationship between temperature and PT delay.",
        "missing": "No delay data in this period.",
    },
}

# Zoning.
KM_PER_DEGREE = 111.0
CELL_KM = 1.0
MIN_STOPS_PER_CELL = 15
MIN_ZONES = 8
PERMUTATIONS = 999
LISA_ALPHA = 0.05
ZONE_SEED = 42
ISLAND_NEIGHBOURS = 2
KMEANS_ZONES = 6
KMEANS_STARTS = 10
KMEANS_ITERATIONS = 300

CITY_BOX = {"lat_min": 59.85, "lat_max": 60.00, "lon_min": 10.60, "lon_max": 10.85}

# city, transit operator code, centre latitude, centre longitude, half height, half width (degrees)
CITIES = (
    ("Oslo", "RUT", 59.925, 10.725, 0.075, 0.125),
    ("Bergen", "SKY", 60.39, 5.32, 0.075, 0.125),
    ("Trondheim", "ATB", 63.43, 10.39, 0.075, 0.125),
    ("Stavanger", "KOL", 58.97, 5.73, 0.075, 0.125),
    ("Kristiansand", "AKT", 58.15, 7.99, 0.06, 0.10),
    ("Tromso", "TRO", 69.65, 18.96, 0.06, 0.10),
)

# Anomaly detection.
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_SEED = 42
FOREST_THRESHOLD = 0.5
SCORE_BINS = 32
ROLLING_ROWS = 24
BOX_EPSILON = 1e-9
BOX_WHISKER = 1.5

# Feed health.
NOMINAL_INTERVAL_SECONDS = {"trips": 60, "flights": 180, "bikes": 180, "road": 180}
ON_TIME_FACTOR = 2
OUTAGE_FACTOR = 10
MAX_LATENCY_SECONDS = 3600
CYCLES = 5
MIN_CYCLE_FILES = 20

# Provider labels carried in the `source` column of normalized tables.
SOURCE_LABELS = {
    "flights": "avinor",
    "trips": "entur_siri_et",
    "bikes": "oslobysykkel",
    "road_weather": "vegvesen",
    "travel_times": "vegvesen",
    "situations": "vegvesen",
}

# File-name tests in order; the first hit names the feed.
FILE_NAME_TESTS = (
    ("entur_siri_et", "trips"),
    ("avinor", "flights"),
    ("oslobysykkel", "bikes"),
    ("vegvesen_traffic_situations", "situations"),
    ("vegvesen_travel_times", "travel_times"),
    ("vegvesen", "road_weather"),
)

# Raw landing folder and file-name globs of each feed.
RAW_LAYOUT = {
    "flights": ("avinor", ("*.parquet",)),
    "bikes": ("oslobysykkel", ("*station_status*.parquet",)),
    "bike_stations": ("oslobysykkel", ("*station_information*.parquet",)),
    "road_weather": ("vegvesen", ("*weather_data*.parquet",)),
    "travel_times": ("vegvesen", ("*travel_times*.parquet",)),
    "situations": ("vegvesen", ("*traffic_situations*.parquet",)),
    "trips": ("entur", ("*_siri_et_*.parquet", "*trip-updates*.parquet")),
}

# Fixed path of the weather-site reference table.
WEATHER_SITES = "vegvesen/reference/weather_site_table.parquet"

# Substrings that find the time, type and location column of a flattened situation record.
SITUATION_TIME_NEEDLES = ("creationtime", "overallstarttime", "timevalue", "startofperiod")
SITUATION_TYPE_NEEDLES = ("situationtype", "reporttype", "situationrecordtype")
SITUATION_LOCATION_NEEDLES = (
    "locationreference", "alertclocation", "countynumber", "locationid", "predefinedlocation", "@id",
)
SITUATION_LOCATION_STOPS = ("location", "county", "alert")

# Columns a normalized table must have before it can be analysed.
REQUIRED_COLUMNS = {
    "flights": ("timestamp", "location", "metric_value", "source"),
    "trips": ("timestamp", "departure_timestamp", "max_departure_delay_sec", "max_arrival_delay_sec"),
    "bikes": ("timestamp", "location", "metric_value", "source"),
    "road_weather": ("timestamp", "location", "road_temperature", "source"),
    "travel_times": (
        "location_id", "period_start", "period_end", "free_flow_travel_time_sec", "traffic_status", "source",
    ),
}

# Index variants and the columns they add up.
INDEX_VARIANTS = {
    "bike_pt": ("bikes_in_use", "public_transport_activity"),
    "bike_pt_flight": ("bikes_in_use", "public_transport_activity", "flight_activity"),
}


@dataclass(frozen=True)
class Period:
    """A named analysis window; both ends count."""

    name: str
    start: datetime
    end: datetime
    weekday_only: bool = False
    weekend_only: bool = False


def days(name: str, first: str, last: str, **flags: bool) -> Period:
    """Period from the first second of `first` to the last second of `last` (ISO dates, UTC)."""
    start = datetime.fromisoformat(first).replace(tzinfo=timezone.utc)
    end = datetime.fromisoformat(last).replace(hour=23, minute=59, second=59, tzinfo=timezone.utc)
    return Period(name, start, end, **flags)


# Named period sets.
PERIOD_SETS = {
    "three_phases": (
        days("Pre-Christmas (Dec 20–26)", "2025-12-20", "2025-12-26"),
        days("Turn of year (Dec 27 – Jan 2)", "2025-12-27", "2026-01-02"),
        days("Early January (Jan 3–11)", "2026-01-03", "2026-01-11"),
    ),
    "two_weeks": (
        days("Week 1 (Dec 20–26)", "2025-12-20", "2025-12-26"),
        days("Week 2 (Dec 27 – Jan 2)", "2025-12-27", "2026-01-02"),
        days("Week 3 (Jan 3–9)", "2026-01-03", "2026-01-09"),
    ),
    "dec_jan": (
        days("December (Dec 20–31)", "2025-12-20", "2025-12-31"),
        days("January (Jan 1–11)", "2026-01-01", "2026-01-11"),
    ),
    "four_windows": (
        days("Window 1 (Dec 20–25)", "2025-12-20", "2025-12-25"),
        days("Window 2 (Dec 26–31)", "2025-12-26", "2025-12-31"),
        days("Window 3 (Jan 1–5)", "2026-01-01", "2026-01-05"),
        days("Window 4 (Jan 6–11)", "2026-01-06", "2026-01-11"),
    ),
    "weekday_weekend": (
        days("Weekdays (Mon–Fri)", "2025-12-20", "2026-01-11", weekday_only=True),
        days("Weekend (Sat–Sun)", "2025-12-20", "2026-01-11", weekend_only=True),
    ),
    "jan30_feb16": (
        days("Week 1 (Jan 30 – Feb 5)", "2026-01-30", "2026-02-05"),
        days("Week 2 (Feb 6 – Feb 12)", "2026-02-06", "2026-02-12"),
        days("Week 3 (Feb 13 – Feb 16)", "2026-02-13", "2026-02-16"),
    ),
    "wa_wb_wc": (
        days("W-A (2025-12-20 – 2026-01-04)", "2025-12-20", "2026-01-04"),
        days("W-B (2026-01-31 – 2026-02-07)", "2026-01-31", "2026-02-07"),
        days("W-C (2026-03-07 – 2026-03-14)", "2026-03-07", "2026-03-14"),
    ),
    "wa1_wa2_wb_wc": (
        days("W-A1 (2025-12-20 – 2025-12-27)", "2025-12-20", "2025-12-27"),
        days("W-A2 (2025-12-28 – 2026-01-04)", "2025-12-28", "2026-01-04"),
        days("W-B (2026-01-31 – 2026-02-07)", "2026-01-31", "2026-02-07"),
        days("W-C (2026-03-07 – 2026-03-14)", "2026-03-07", "2026-03-14"),
    ),
}
