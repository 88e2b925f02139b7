"""GEOGRAPHY points as struct(lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000


def st_geogpoint(lon: Column, lat: Column) -> Column:
    """Latitudes beyond 90 degrees are an error; longitudes are brought into [-180, 180)."""
    checked = F.when(F.abs(lat) > 90, F.raise_error(F.lit("latitude out of range"))).otherwise(lat)
    return F.struct((F.pmod(lon + 180, F.lit(360.0)) - 180).alias("lon"), checked.alias("lat"))


def st_geogfromtext(text: Column) -> Column:
    """WKT ``POINT (lon lat)``."""
    number = r"(-?[0-9.]+)"
    pattern = rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return st_geogpoint(F.regexp_extract(text, pattern, 1).cast("double"), F.regexp_extract(text, pattern, 2).cast("double"))


def st_distance(a: Column, b: Column) -> Column:
    """Haversine distance in metres."""
    rise, run = F.radians(b["lat"] - a["lat"]), F.radians(b["lon"] - a["lon"])
    h = F.pow(F.sin(rise / 2), F.lit(2)) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(run / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))
