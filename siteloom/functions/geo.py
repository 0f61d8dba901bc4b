"""Geometry column expressions on longitude and latitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088  # mean radius, for distances and areas
ROUTE_EARTH_KM = 6371.0  # the radius the route estimates use
KM_PER_DEGREE = 111.195


def synthetic_lon(key: Column) -> Column:
    """A longitude in [67, 98) that a whole-number key decides."""
    return F.lit(67.0) + F.pmod(key * F.lit(7919), F.lit(31000)) / F.lit(1000.0)


def synthetic_lat(key: Column) -> Column:
    """A latitude in [6, 38) that a whole-number key decides."""
    return F.lit(6.0) + F.pmod(key * F.lit(10473), F.lit(32000)) / F.lit(1000.0)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def tile_x(lon: Column, zoom: int) -> Column:
    """Web-Mercator tile column, as a fraction."""
    return (lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(2**zoom))


def tile_y(lat: Column, zoom: int) -> Column:
    """Web-Mercator tile row, as a fraction."""
    r = F.radians(lat)
    return (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.lit(math.pi)) / F.lit(2.0) * F.lit(float(2**zoom))


def segment_km(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment on a plane tangent at the point."""
    k = F.lit(EARTH_KM * math.pi / 180)
    c = F.cos(F.radians(lat))
    x1, y1, x2, y2 = (ax - lon) * c * k, (ay - lat) * k, (bx - lon) * c * k, (by - lat) * k
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(x1 * dx + y1 * dy) / length)))
    px, py = x1 + t * dx, y1 + t * dy
    return F.sqrt(px * px + py * py)


def sql_lon(key: str) -> str:
    return f"(67.0::DOUBLE + (({key}) * 7919 % 31000) / 1000.0::DOUBLE)"


def sql_lat(key: str) -> str:
    return f"(6.0::DOUBLE + (({key}) * 10473 % 32000) / 1000.0::DOUBLE)"


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_KM) -> str:
    return f"({2 * radius!r}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
