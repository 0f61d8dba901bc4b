"""Buffers on the sphere as rings: circles, offsets of convex rings, and capsules around edges.

A buffer of any ring is the ring and a capsule around each of its edges; the
parts need not be dissolved, as ``coverage`` counts what they cover once and
takes a core off as a hole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM

STEPS = 128  # corners of a full circle: its area is short of the circle's by 0.04 %


def destination(p: Column, bearing: Column, km: Column) -> Column:
    """The point ``km`` away from ``p`` (x, y) in a direction in degrees east of north."""
    d, lat, lon, b = km / F.lit(EARTH_KM), F.radians(p["y"]), F.radians(p["x"]), F.radians(bearing)
    there = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(b))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(there))
    return F.struct(F.degrees(lon + east).alias("x"), F.degrees(there).alias("y"))


def bearing(p: Column, q: Column) -> Column:
    """Direction from ``p`` to ``q`` at ``p``, in degrees east of north."""
    a, b, d = F.radians(p["y"]), F.radians(q["y"]), F.radians(q["x"] - p["x"])
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def arc(p: Column, start: Column, turn: Column, km: Column, steps: int = STEPS) -> Column:
    """Points around ``p`` from direction ``start`` over ``turn`` degrees to the left, both ends included."""
    n = F.greatest(F.lit(1), F.ceil(turn * steps / 360)).cast("int")
    # The directions are worked out once and not for each point: they are the only element of an array that is gone through.
    once = F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), start.alias("start"), turn.alias("turn"), n.alias("n")))
    return F.flatten(F.transform(once, lambda o: F.transform(F.sequence(F.lit(0), o["n"]), lambda i: destination(o, o["start"] - o["turn"] * i / o["n"], km))))


def circle(p: Column, km: Column, steps: int = STEPS) -> Column:
    """An open ring around a point, counter-clockwise."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: destination(p, F.lit(90.0) - i * (360.0 / steps), km))


def capsule(p: Column, q: Column, km: Column) -> Column:
    """An open ring around the line from ``p`` to ``q``, counter-clockwise: half a circle about each end."""
    there, back = bearing(p, q), bearing(q, p)
    return F.concat(arc(q, there + 90, F.lit(180.0), km), arc(p, back + 90, F.lit(180.0), km))


def convex_buffer(ring: Column, km: Column) -> Column:
    """The offset of a convex open ring that runs counter-clockwise: at each corner an arc from one edge's outside to the next one's. One corner gives a circle, two a capsule."""
    n = F.size(ring)

    def corner(p: Column, i: Column) -> Column:
        before, after = F.get(ring, F.pmod(i - 1, n)), F.get(ring, F.pmod(i + 1, n))
        start = bearing(p, before) - 90  # right of the edge that arrives, seen from its end
        turn = F.pmod(start - (bearing(p, after) + 90), F.lit(360.0))
        return arc(p, start, F.when(turn > 359.9999999, 0.0).otherwise(turn), km)

    return F.when(n == 1, circle(F.get(ring, 0), km)).when(n == 2, capsule(F.get(ring, 0), F.get(ring, 1), km)).otherwise(F.flatten(F.transform(ring, corner)))


def buffer_parts(rings: DataFrame, ring: str, km: Column) -> DataFrame:
    """``rings`` with ``part``, an open ring: the ring itself and a capsule around each edge. Together they cover the buffer."""
    own = F.col(ring)
    edges = F.transform(own, lambda p, i: capsule(p, F.get(own, F.pmod(i + 1, F.size(own))), km))
    return rings.withColumn("part", F.explode(F.concat(F.array(own), edges)))


def circle_km2(km: float) -> float:
    """Area within ``km`` of a point on the sphere."""
    return 2 * math.pi * EARTH_KM**2 * (1 - math.cos(km / EARTH_KM))
