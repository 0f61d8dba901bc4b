"""Rings and hulls: canonical form, validation, area, geohash, convex hull."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM
from siteloom.functions.numeric import half_up

# Limits of an area of interest.
MAX_VERTICES, MIN_KM2, MAX_KM2 = 100, 1.0, 2500.0
BOX = (67.0, 6.0, 98.0, 38.0)


def canonical(ring: Column) -> Column:
    """An array of (x, y) at six decimals, without repeats of a point after itself, also across the end, and open."""
    rounded = F.transform(ring, lambda p: F.struct((half_up(p["x"], 6) + F.lit(0.0)).alias("x"), (half_up(p["y"], 6) + F.lit(0.0)).alias("y")))
    once = F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))
    last = F.get(once, F.size(once) - 1)
    return F.when((F.size(once) > 1) & (F.get(once, F.lit(0)) == last), F.slice(once, 1, F.greatest(F.size(once) - 1, F.lit(0)))).otherwise(once)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def area_km2(ring: Column) -> Column:
    """Area of an open ring on the sphere."""

    def total(own: Column) -> Column:
        def term(p: Column, i: Column) -> Column:
            q = F.get(own, F.pmod(i + 1, F.size(own)))
            return F.radians(q["x"] - p["x"]) * (F.lit(2.0) + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"])))

        return F.aggregate(F.transform(own, term), F.lit(0.0), lambda a, t: a + t)

    return F.abs(once(ring, total)) * F.lit(EARTH_KM**2 / 2)


def crosses_itself(ring: Column) -> Column:
    """True if two edges of an open ring that share no corner cross."""
    n = F.size(ring)
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def meets(i: Column, j: Column) -> Column:
        a, b, c, d = F.get(ring, i), F.get(ring, i + 1), F.get(ring, j), F.get(ring, F.pmod(j + 1, n))
        return ((i > 0) | (j < n - 1)) & (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    later = lambda i: F.when(i + 2 <= n - 1, F.sequence(i + 2, n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n >= 4, F.exists(F.sequence(F.lit(0), n - 3), lambda i: F.exists(later(i), lambda j: meets(i, j)))).otherwise(False)


def error_code(raw: Column, ring: Column) -> Column:
    """The first rule that a ring breaks, or null; ``ring`` is the canonical form of ``raw``."""
    outside = F.exists(ring, lambda p: (p["x"] < BOX[0]) | (p["x"] > BOX[2]) | (p["y"] < BOX[1]) | (p["y"] > BOX[3]))
    area = area_km2(ring)
    return (
        F.when(F.size(raw) < 3, "too_few_vertices").when(F.size(raw) > MAX_VERTICES, "too_many_vertices").when(F.size(ring) < 3, "degenerate")
        .when(crosses_itself(ring), "self_intersection").when(area < MIN_KM2, "too_small").when(area > MAX_KM2, "too_large").when(outside, "outside")
    )


ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lon: Column, lat: Column, length: int = 8) -> Column:
    """Base-32 geohash: bits of longitude and latitude in turn, five to a letter."""
    bits = length * 5
    x = F.least(F.lit((1 << 30) - 1), F.floor((lon + 180) / 360 * float(1 << 30))).cast("long")
    y = F.least(F.lit((1 << 30) - 1), F.floor((lat + 90) / 180 * float(1 << 30))).cast("long")
    bit = lambda i: F.shiftright(x if i % 2 == 0 else y, 29 - i // 2).bitwiseAND(F.lit(1))
    letters = []
    for at in range(0, bits, 5):
        number = sum((bit(at + k) * (1 << (4 - k)) for k in range(1, 5)), bit(at) * 16)
        letters.append(F.substr(F.lit(ALPHABET), (number + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def hull(points: np.ndarray | list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the leftmost point."""
    rows = sorted(set(map(tuple, points)))
    if len(rows) < 3:
        return rows

    def half(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(rows) + half(rows[::-1])


def hull_rings(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, hull): the hull of each key's points, as an open array of (x, y).

    Each task first takes the hulls of its own rows, so that what meets for a
    key is the corners of as many hulls as there were batches, however many
    points the key has.
    """
    slim = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    kind = slim.schema["key"].dataType.simpleString()

    def arrays(hulls: list[list[tuple[float, float]]]) -> list[pa.Array]:
        """The hulls' xs and ys."""
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in hulls]))).astype(np.int32))
        corners = np.array([p for h in hulls for p in h], float).reshape(-1, 2)
        return [pa.ListArray.from_arrays(offsets, pa.array(corners[:, i])) for i in (0, 1)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("key").dictionary_encode(null_encoding="encode")
            own: list[list] = [[] for _ in range(len(coded.dictionary))]
            for k, *p in zip(coded.indices.to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own[k].append(p)
            yield pa.RecordBatch.from_arrays([coded.dictionary, *arrays([hull(points) for points in own])], names=["key", "xs", "ys"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays([hull(list(zip(xs, ys, strict=True))) for xs, ys in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True)])], names=["key", "xs", "ys"])

    lists = f"key {kind}, xs array<double>, ys array<double>"
    parts = slim.mapInArrow(partial, lists).groupBy("key").agg(F.collect_list(F.struct("xs", "ys")).alias("parts"))
    met = parts.select("key", *[F.flatten(F.transform("parts", lambda p: p[c])).alias(c) for c in ("xs", "ys")]).mapInArrow(final, lists)
    return met.select(F.col("key").alias(key), F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("hull"))


def convex_hulls(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, y, corner): the corners of each key's hull in a row each."""
    return hull_rings(df, key, x, y).select(key, F.posexplode("hull").alias("corner", "p")).select(key, "p.x", "p.y", "corner")


def kms_square(lon: Column, lat: Column, km: float) -> Column:
    """A closed square of side ``km`` around a point, as an array of (x, y)."""
    dy = F.lit(km / 2 / 110.574)
    dx = F.lit(km / 2 / 111.32) / F.cos(F.radians(lat))
    corner = lambda a, b: F.struct((lon + a * dx).alias("x"), (lat + b * dy).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def degrees_of(km: float) -> float:
    return km / (EARTH_KM * math.pi / 180)


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that line simplification keeps: a point stays if it lies over ``tolerance`` off the line of its neighbours that stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, own = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        off = np.hypot(own[:, 0], own[:, 1]) if length == 0 else np.abs(own[:, 0] * d[1] - own[:, 1] * d[0]) / length
        if off.max() > tolerance:
            middle = a + 1 + int(off.argmax())
            keep[middle] = True
            spans += [(a, middle), (middle, b)]
    return np.flatnonzero(keep)


def simplify(x: Column, y: Column, tolerance: float) -> Column:
    """Places kept of a line given as arrays of its coordinates; lines of two points or fewer stay whole."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(xs: pd.Series, ys: pd.Series) -> pd.Series:
        line = lambda a, b: np.stack([np.asarray(a, float), np.asarray(b, float)], axis=1)
        return pd.Series([simplified(line(a, b), tolerance).tolist() if len(a) > 2 else list(range(len(a))) for a, b in zip(xs, ys, strict=True)])

    return places(x, y)


def zone_class(r: Column, g: Column, b: Column) -> Column:
    """The zone a map pixel's fill colour stands for, strictest first; lines and backgrounds are none."""
    red = (r >= F.greatest(g, b) + 60) & (r >= 120)
    yellow = (r >= 170) & (g >= 170) & (b <= 130)
    green = (g >= 110) & (g >= r + 25) & (b <= 130) & (g >= b + 40)
    return F.when(red, "red").when(yellow, "amber").when(green, "green")


def clipped(ring: Column, window: Column) -> Column:
    """The part of an open ring inside a convex open ring that runs counter-clockwise; empty if they don't meet.

    The ring is cut along each edge of the window in turn: a corner inside stays, and an edge that crosses gives the crossing.
    """
    corner = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    none = F.slice(F.array(corner), 1, 0)

    def cut(own: Column, ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def edge(pair: Column) -> Column:
            p, q, s, t = (pair[c] for c in "pqst")
            at = F.when(s != t, s / (s - t)).otherwise(0.0)
            crossing = F.struct((p["x"] + (q["x"] - p["x"]) * at).alias("x"), (p["y"] + (q["y"] - p["y"]) * at).alias("y"))
            return F.when((s >= 0) & (t >= 0), F.array(q)).when(s >= 0, F.array(crossing)).when(t >= 0, F.array(crossing, q)).otherwise(none)

        def pair(p: Column, j: Column) -> Column:
            return once(F.get(own, F.pmod(j + 1, F.size(own))), lambda q: F.struct(p.alias("p"), q.alias("q"), side(p).alias("s"), side(q).alias("t")))

        return F.flatten(F.transform(F.transform(own, pair), edge))

    # The ring and the window are bound once: named again in every step, they would be built again there.
    sides = once(window, lambda w: F.transform(w, lambda a, i: F.struct(a.alias("a"), F.get(w, F.pmod(i + 1, F.size(w))).alias("b"))))
    return F.aggregate(sides, ring, cut)
