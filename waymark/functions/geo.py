"""Geometry: points are [longitude, latitude] in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def points(geom_type: Column, coordinates: Column) -> Column:
    """The points of a geometry from its raw JSON coordinates: a line's, the lines' of a multi-line one after another, none of any other."""
    line = F.from_json(coordinates, "array<array<double>>")
    lines = F.flatten(F.from_json(coordinates, "array<array<array<double>>>"))
    none = F.array().cast("array<array<double>>")
    return F.coalesce(F.when(geom_type == "LineString", line).when(geom_type == "MultiLineString", lines), none)


def rounded(pts: Column, digits: int = 6) -> Column:
    return F.transform(pts, lambda p: F.transform(p, lambda x: F.round(x, digits)))


def repeats_point(pts: Column) -> Column:
    """True if a point follows an equal one."""
    pairs = F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda a, b: a == b)
    return F.when(F.size(pts) < 2, F.lit(False)).otherwise(F.exists(pairs, lambda x: x))


def in_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Strictly inside the box and not at (0, 0)."""
    return (lon > west) & (lon < east) & (lat > south) & (lat < north) & ~((lon == 0) & (lat == 0))
