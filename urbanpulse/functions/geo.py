"""Grid cells, boxes and map tiles as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanpulse.fixed import CELL_KM, CITY_BOX, KM_PER_DEGREE


def in_box(lat: Column, lon: Column, box: dict[str, float] = CITY_BOX) -> Column:
    """Closed box: the edges belong to it."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])


def near_centre(lat: Column, lon: Column, lat_c: Column, lon_c: Column, dlat: Column, dlon: Column) -> Column:
    """Open box around a centre: the edges do not belong to it."""
    return (F.abs(lat - lat_c) < dlat) & (F.abs(lon - lon_c) < dlon)


def lat_step(cell_km: float = CELL_KM) -> float:
    return cell_km / KM_PER_DEGREE


def lon_step(lat_c: Column, cell_km: float = CELL_KM) -> Column:
    return F.lit(cell_km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat_c)))


def cell_index(value: Column, centre: Column, half: Column, step: Column | float) -> Column:
    return F.floor((value - (centre - half)) / step).cast("int")


def zone_name(city: Column, cx: Column, cy: Column) -> Column:
    return F.concat_ws("_", city, cx.cast("string"), cy.cast("string"))


def cell_box(cx: Column, cy: Column, lat_c: Column, lon_c: Column, dlat: Column, dlon: Column,
             cell_km: float = CELL_KM) -> list[Column]:
    """South, north, west and east edge of a grid cell."""
    south = (lat_c - dlat) + cx * lat_step(cell_km)
    west = (lon_c - dlon) + cy * lon_step(lat_c, cell_km)
    return [
        south.alias("south"), (south + lat_step(cell_km)).alias("north"),
        west.alias("west"), (west + lon_step(lat_c, cell_km)).alias("east"),
    ]


def tile_x(lon: Column, zoom: int) -> Column:
    return ((lon + 180.0) / 360.0 * float(2**zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    """Web-Mercator row of a latitude."""
    stretched = F.asinh(F.tan(F.radians(lat))) / math.pi
    return ((1.0 - stretched) / 2.0 * float(2**zoom)).cast("int")


def tile_corner(x: Column, y: Column, zoom: int) -> list[Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = float(2**zoom)
    lat = F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n))))
    return [(x / n * 360.0 - 180.0).alias("lon"), lat.alias("lat")]
