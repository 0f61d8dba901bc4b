"""What many upright squares share with many others, without their pairs.

The part of two squares that lies in both is as wide as a piece of one or of the
other, or as the gap between a side of each; so is its height. Over all zones
whose sides lie alike to an area's sides, the sum of width times height is then
a few sums over the zones alone and a few numbers of the area. An area asks for
these sums in nine boxes; sums below and left of a corner, held for blocks of
twice, four times, eight times ... as many zones, give a box in a few steps.
Work grows with zones and areas times a logarithm, not with how many meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM
from siteloom.operators.proximity import spread_over

CELL = 1.0  # degrees of a cell whose zones are summed up together
BLOCK = 1 << 15  # zones, and areas, that a task holds at once


def squares_overlap(areas: DataFrame, zones: DataFrame, half_area: float, half_zone: float, block: int = BLOCK, cell: float = CELL) -> DataFrame:
    """``site``, ``class``, ``zones`` and ``km2``: of each area (site, lon, lat: its middle) how many zones of a class (class, zx, zy) share more than a border with it, and the areas they share, each zone on its own.

    Sides are ``half_area`` and ``half_zone`` degrees from the middle; zones are no wider than areas.
    """
    if half_zone > half_area:
        raise ValueError("zones are wider than areas")
    reach = (half_area + half_zone) * 1.001
    place = ["class", "cx", "cy"]
    alike = zones.where("zx IS NOT NULL AND zy IS NOT NULL").groupBy("class", "zx", "zy").agg(F.count("*").alias("times"))
    held = alike.withColumns({"cx": F.floor(F.col("zx") / cell).cast("int"), "cy": F.floor(F.col("zy") / cell).cast("int")})
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / cell).cast("int"), F.floor((F.col(c) + reach) / cell).cast("int")))
    near = areas.where("lon IS NOT NULL AND lat IS NOT NULL").select("site", "lon", "lat", cells("lon").alias("cx")).withColumn("cy", cells("lat"))
    many = lambda d, keys, name: d.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # Each block of a cell's zones meets each block of its areas.
    dealt = many(held, place, "parts").join(many(near, ["cx", "cy"], "shares"), ["cx", "cy"])
    key = [*place, "part", "share"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = near.join(dealt.hint("merge"), ["cx", "cy"]).withColumn("share", own("shares", "site", "lon", "lat")).withColumn("part", every("parts")).select(*key, "site", "lon", "lat")
    sized = dealt.select(*(F.col(c).alias(f"at_{c}") for c in place), "parts", "shares")
    right = held.join(sized.hint("merge"), (F.col("cx") == F.col("at_cx")) & (F.col("cy") == F.col("at_cy")) & F.col("class").eqNullSafe(F.col("at_class"))).withColumn("part", own("parts", "zx", "zy")).withColumn("share", every("shares")).select(*(F.col(c).alias(f"of_{c}") for c in key), "zx", "zy", "times")
    tasks = spread_over(areas)
    kinds = {f.name: f.dataType.simpleString() for f in (*areas.schema, *zones.schema)}
    schema = f"site {kinds['site']}, class {kinds['class']}, zones long, km2 double"
    sides = left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *(f"of_{c}" for c in key)).groupBy(*(f"of_{c}" for c in key)))
    return sides.applyInArrow(_shared(half_area, half_zone), schema).groupBy("site", "class").agg(F.sum("zones").alias("zones"), F.sum("km2").alias("km2"))


def _shared(half_area: float, half_zone: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def shared(areas: pa.Table, zones: pa.Table) -> pa.Table:
        if not areas.num_rows or not zones.num_rows:
            return pa.table({"site": areas.column("site")[:0], "class": zones.column("of_class")[:0], "zones": pa.array([], pa.int64()), "km2": pa.array([], pa.float64())})
        columns = lambda t, *names: (t.column(c).to_numpy() for c in names)
        count, km2 = shared_each(*columns(areas, "lon", "lat"), *columns(zones, "zx", "zy", "times"), half_area, half_zone)
        met = pa.array(count > 0)
        kind = zones.column("of_class")[:1].combine_chunks().take(pa.array(np.zeros(areas.num_rows, np.int64)))
        return pa.table({"site": areas.column("site"), "class": kind, "zones": count, "km2": km2}).filter(met)

    return shared


def _sides(middle: np.ndarray, half_area: float, own: np.ndarray, half_zone: float) -> np.ndarray:
    """For each area the places in the sorted middles ``own`` of zones, from the first that reaches into it, where those are within its lower side, where those cross its upper side, and where those end."""
    low, high = own - half_zone, own + half_zone
    at, to = middle - half_area, middle + half_area
    return np.stack([np.searchsorted(high, at, "right"), np.searchsorted(low, at, "right"), np.searchsorted(high, to, "left"), np.searchsorted(low, to, "left")])


def shared_each(lon: np.ndarray, lat: np.ndarray, zx: np.ndarray, zy: np.ndarray, times: np.ndarray, half_area: float, half_zone: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each area the number of zones, each counted so many ``times``, that share more than a border with it, and the sum of what they share in km2."""
    order = np.argsort(zx, kind="stable")
    zx, zy, times = zx[order], zy[order], times[order]
    up = np.argsort(zy, kind="stable")
    rank = np.empty(len(zy), np.int64)
    rank[up] = np.arange(len(zy))
    x, y = _sides(lon, half_area, zx, half_zone), _sides(lat, half_area, zy[up], half_zone)
    # Longitudes and sines from the middle of the zones, in long doubles: sums are told from sums, and lose no digits that a pair's product has.
    x0, s0 = zx[len(zx) // 2], np.sin(np.radians(zy[up[len(zy) // 2]]))
    sine = lambda v: (np.sin(np.radians(v)) - s0).astype(np.longdouble)
    u, top, bottom, n = (zx - x0).astype(np.longdouble), sine(zy + half_zone), sine(zy - half_zone), times.astype(np.longdouble)
    sums = _below(np.stack([n, n * u, n * top, n * u * top, n * bottom, n * u * bottom], axis=1), rank, x, y)
    boxes = np.diff(np.diff(sums, axis=0), axis=1)
    at, to = (lon - half_area - x0).astype(np.longdouble), (lon + half_area - x0).astype(np.longdouble)
    low, high = sine(lat - half_area), sine(lat + half_area)
    half, km2 = np.longdouble(half_zone), np.zeros(len(lon), np.longdouble)
    # A width is a * u + b; a height is the zone's own top or the area's, less the zone's own bottom or the area's.
    for i, (a, b) in enumerate(((1, half - at), (0, 2 * half), (-1, to + half))):
        for j, (over, under) in enumerate(((None, low), (None, None), (high, None))):
            one, moved = (boxes[i, j, :, k::2] for k in (0, 1))
            part = lambda k: a * moved[:, k] + b * one[:, k]  # noqa: E731, B023
            km2 += (part(1) if over is None else over * part(0)) - (part(2) if under is None else under * part(0))
    count = np.rint(boxes[..., 0].sum(axis=(0, 1))).astype(np.int64)
    return count, (np.radians(km2) * EARTH_KM**2).astype(np.float64)


def _below(values: np.ndarray, rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` among the first x[i] whose rank is below y[j], for each i, j and area."""
    n = len(values)
    out = np.zeros((len(x), len(y), x.shape[1], values.shape[1]), np.longdouble)
    for level in range(n.bit_length()):
        name = (np.arange(n) >> level) * (n + 1) + rank
        order = np.argsort(name, kind="stable")
        name = name[order]
        upto = np.concatenate((np.zeros((1, values.shape[1]), np.longdouble), np.cumsum(values[order], axis=0)))
        for i, own in enumerate(x):
            some = np.flatnonzero(own >> level & 1)  # the first x[i] are one block of this size and smaller or larger ones
            which = (own[some] >> level) - 1
            start = upto[which << level]
            for j in range(len(y)):
                out[i, j, some] += upto[np.searchsorted(name, which * (n + 1) + y[j, some])] - start
    return out
