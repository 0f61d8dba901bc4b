"""Spatial joins as equi-joins on grid cells.

Points are binned into cells at least as wide as the reach of the join; one
side is repeated over the cells around it, both meet by cell, and an exact
test follows. The plan is an ordinary hash join whose keys spread over the
map, so it needs neither a spatial index nor a nested loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions.geo import KM_PER_DEGREE, haversine_km

MAX_LAT = 38.5  # of the map; a degree of longitude is shortest there


def cell_degrees(reach_km: float) -> tuple[float, float]:
    """Cell width and height in degrees so that ``reach_km`` never spans more than one cell."""
    return reach_km / (KM_PER_DEGREE * math.cos(math.radians(MAX_LAT))) * 1.01, reach_km / KM_PER_DEGREE * 1.01


def cells(lon: Column, lat: Column, size: tuple[float, float]) -> tuple[Column, Column]:
    return F.floor(lon / F.lit(size[0])).cast("int"), F.floor(lat / F.lit(size[1])).cast("int")


def around(df: DataFrame, lon: str, lat: str, size: tuple[float, float]) -> DataFrame:
    """``df`` once for each of the nine cells around its point, as cx and cy."""
    cx, cy = cells(F.col(lon), F.col(lat), size)
    steps = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("cell", F.explode(steps)).select(*df.columns, "cell.cx", "cell.cy")


def within_radius(sites: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Pairs of a site (lon, lat) and a point (plon, plat) at most ``km`` apart, with the distance as ``km``."""
    size = cell_degrees(km)
    px, py = cells(F.col("plon"), F.col("plat"), size)
    binned = points.withColumns({"cx": px, "cy": py})
    met = around(sites, "lon", "lat", size).join(binned.hint("merge"), ["cx", "cy"]).drop("cx", "cy")
    return met.withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))).where(F.col("km") <= km)


def nearest(pairs: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first pair of each key in the given order."""
    return pairs.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def ring_edges(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """One row per edge (ax, ay, bx, by) of each closed ring: an array of (x, y) structs."""
    ends = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))
    return rings.select(key, F.explode(ends).alias("e")).select(key, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: a point is inside if a ray from it crosses the closed ring an odd number of times."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), F.lit(1)).otherwise(F.lit(0))

    crossings = F.aggregate(F.transform(F.sequence(F.lit(1), F.size(ring) - 1), crosses), F.lit(0), lambda s, c: s + c)
    return crossings % 2 == 1


def near_ring(x: Column, y: Column, ring: Column, border: float) -> Column:
    """Whether a point lies within ``border`` degrees of an edge of the closed ring."""

    def close(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / length)))
        px, py = a["x"] + t * dx - x, a["y"] + t * dy - y
        return px * px + py * py <= border * border

    return F.exists(F.sequence(F.lit(1), F.size(ring) - 1), close)


def points_in_rings(points: DataFrame, rings: DataFrame, ring: str, cell: float, border: float = 0.0) -> DataFrame:
    """Pairs of a point (plon, plat) and a ring that holds it.

    Rings are repeated over the cells of ``cell`` degrees that their bounding
    box touches, and points are binned into the same cells. The even-odd rule
    leaves open on which side of an edge a point on it falls: with ``border``,
    points that near an edge are kept too, for an exact test by the caller.
    """
    low = lambda f: F.floor((F.array_min(F.transform(ring, lambda p: p[f])) - border) / F.lit(cell)).cast("int")
    high = lambda f: F.floor((F.array_max(F.transform(ring, lambda p: p[f])) + border) / F.lit(cell)).cast("int")
    spread = rings.withColumn("cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y"))))
    px, py = cells(F.col("plon"), F.col("plat"), (cell, cell))
    held = inside_ring(F.col("plon"), F.col("plat"), F.col(ring))
    if border:
        held = held | near_ring(F.col("plon"), F.col("plat"), F.col(ring), border)
    return points.withColumns({"cx": px, "cy": py}).join(spread, ["cx", "cy"]).where(held).drop("cx", "cy")
