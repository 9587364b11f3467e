"""Great-circle and planar distances, and grid cells for distance joins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d_lat = F.radians(lat2) - F.radians(lat1)
    d_lng = F.radians(lng2 - lng1)
    s_lat = F.sin(d_lat / 2)
    s_lng = F.sin(d_lng / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.hypot(lat1 - lat2, lng1 - lng2)


def lat_cell(lat: Column, metres: float) -> Column:
    """Index of a latitude band at least ``metres`` high."""
    return F.floor(lat / F.lit(math.degrees(metres / EARTH_M) * 1.0001))


def neighbours(cell: Column) -> Column:
    return F.array(cell - 1, cell, cell + 1)
