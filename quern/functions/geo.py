"""Points on the sphere: distance, radius, bounding box, nearest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.predicates import column

EARTH_M = 6_371_000.0


def haversine(lat, lon, to_lat: float, to_lon: float) -> Column:
    """Metres along the great circle; missing where a coordinate is."""
    a, b = F.radians(column(lat)), F.radians(column(lon))
    c, d = F.radians(F.lit(float(to_lat))), F.radians(F.lit(float(to_lon)))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def in_box(lat, lon, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Inclusive."""
    return column(lat).between(min_lat, max_lat) & column(lon).between(min_lon, max_lon)


def within_radius(lat, lon, to_lat: float, to_lon: float, metres: float) -> Column:
    """The box around the circle goes to the scan as plain ranges, by which sorted files are skipped; the distance decides."""
    angle = metres / EARTH_M * 1.0001
    band = math.degrees(angle)
    near = column(lat).between(to_lat - band, to_lat + band)
    if abs(to_lat) + band < 90 and angle < math.pi / 2:  # a circle that holds no pole lies between two meridians
        side = math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(to_lat)))) + 1e-9
        if to_lon - side >= -180 and to_lon + side <= 180:
            near = near & column(lon).between(to_lon - side, to_lon + side)
    return near & (haversine(lat, lon, to_lat, to_lon) <= metres)


def cell(lat, lon, degrees: float = 1.0) -> Column:
    """The number of a grid cell: a column to sort or partition files by, as a spatial index would."""
    across = math.ceil(360 / degrees)
    return F.floor((column(lat) + 90) / degrees) * across + F.floor((column(lon) + 180) / degrees)


def nearest(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, limit: int | None = None, tie: Sequence[str] = (), distance: str = "distance") -> DataFrame:
    """By distance, points without coordinates last; with a limit, a top-k."""
    out = df.withColumn(distance, haversine(lat, lon, to_lat, to_lon))
    out = out.orderBy(F.col(distance).asc_nulls_last(), *tie)
    return out if limit is None else out.limit(limit)
