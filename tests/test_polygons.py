"""Union areas, repair and buffers against brute force on fine grids."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM
from siteloom.operators import buffers, coverage, repair
from siteloom.operators.shapes import area_km2

SCHEMA = "g int, polygon long, role string, ring array<struct<x: double, y: double>>"


def parity(x, y, ring):
    """Even-odd membership of many points in an open ring."""
    out = np.zeros(np.broadcast(x, y).shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 != y1:
            out ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return out


def grid_km2(rows, within, step=0.002, box=(10.0, 20.0, 11.2, 21.2)):
    xs, ys = np.arange(box[0] + step / 2, box[2], step), np.arange(box[1] + step / 2, box[3], step)
    x, y = np.meshgrid(xs, ys)
    masks = {}
    for polygon, role, ring in rows:
        masks[(role, polygon)] = masks.get((role, polygon), np.zeros(x.shape, bool)) ^ parity(x, y, ring)
    any_of = lambda role: np.any([m for (r, _), m in masks.items() if r == role] or [np.zeros(x.shape, bool)], axis=0)
    inside = any_of("zone") & ~any_of("hole") & (any_of("window") | (not within))
    return float((inside * np.cos(np.radians(y))).sum() * math.radians(step) ** 2 * EARTH_KM**2)


def blob(rng, n, star=False):
    cx, cy, r = 10.1 + rng.random(), 20.1 + rng.random(), 0.05 + 0.3 * rng.random()
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n)) if not star else [4 * math.pi * k / 5 for k in range(5)]
    return [(min(11.15, max(10.05, cx + r * math.cos(t) * (0.4 + 0.6 * rng.random() if not star else 1))), min(21.15, max(20.05, cy + r * math.sin(t)))) for t in turns]


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("crowd", [64, 2])
def test_union_area_equals_a_fine_grid(spark, within, crowd, monkeypatch):
    monkeypatch.setattr(coverage, "CROWD", crowd)
    rng = random.Random(11)
    groups = {}
    for g in range(4):
        rows = [(k, "zone", blob(rng, rng.randrange(3, 9), star=k % 3 == 0)) for k in range(1 + 6 * g)]
        rows += [(rows[0][0] + 500, "zone", rows[0][2])]  # a repeated ring
        rows += [(900, "hole", blob(rng, 6))] if g % 2 else [(901, "zone", [(10.2, 20.2), (10.8, 20.2), (10.8, 20.8), (10.2, 20.8)]), (901, "zone", [(10.3, 20.3), (10.6, 20.3), (10.6, 20.6)])]  # a polygon with a hole
        rows += [(700, "window", [(10.1, 20.1), (11.0, 20.1), (10.5, 20.4), (11.0, 21.0), (10.1, 21.0)])]  # concave
        groups[g] = rows
    parts = spark.createDataFrame([(g, p, role, ring) for g, rows in groups.items() for p, role, ring in rows] + [(9, 1, "zone", []), (9, 2, "zone", [(10.0, 20.0), (11.0, 20.0)])], SCHEMA)
    got = {r["g"]: r["km2"] for r in coverage.covered_km2(parts, ["g"], 0.5, within).collect()}
    for g, rows in groups.items():
        want = grid_km2(rows, within)
        assert abs(got.get(g, 0.0) - want) < 0.004 * want + 0.5
    assert 9 not in got


def test_covering_twice_counts_once_and_cells_change_nothing(spark):
    square = [(10.0, 20.0), (11.0, 20.0), (11.0, 21.0), (10.0, 21.0)]
    half = [(10.5, 20.0), (11.0, 20.0), (11.0, 21.0), (10.5, 21.0)]
    parts = spark.createDataFrame([(1, k, "zone", square) for k in range(50)] + [(1, 60, "zone", half), (2, 1, "zone", half)], SCHEMA)
    exact = EARTH_KM**2 * math.radians(1) * (math.sin(math.radians(21)) - math.sin(math.radians(20)))
    for cell in (0.1, 0.7, 5.0):
        got = {r["g"]: r["km2"] for r in coverage.covered_km2(parts, ["g"], cell).collect()}
        assert abs(got[1] - exact) < 1e-6 and abs(got[2] - exact / 2) < 1e-6


def area_of(polygons):
    return sum(repair.signed_area(np.array(r)) for p in polygons for r in p)


def mended(spark, *rings):
    frame = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in r] for r in rings])], f"id int, rings {repair.RINGS}")
    return [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in repair.repaired(frame, "rings").first()["polygons"]]


def test_bow_ties_stars_holes_and_spikes_come_out_valid(spark):
    assert sorted(len(p) for p in mended(spark, [(0, 0), (2, 2), (2, 0), (0, 2)])) == [1, 1]
    star = mended(spark, [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)])
    assert len(star) == 5 and all(len(p) == 1 and len(p[0]) == 3 for p in star)  # five tips, without the middle
    holed = mended(spark, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2)])
    assert [len(p) for p in holed] == [2] and abs(area_of(holed) - 15) < 1e-9
    spike = mended(spark, [(0, 0), (2, 0), (2, 1), (3, 1), (2, 1), (2, 2), (0, 2)])
    assert [len(p) for p in spike] == [1] and abs(area_of(spike) - 4) < 1e-9
    twice = mended(spark, [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)])
    assert twice == []  # covered twice is even
    touching = mended(spark, [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 1), (1, 2)])  # a hole that touches a corner
    assert [len(p) for p in touching] == [2] and abs(area_of(touching) - 14.5) < 1e-9
    shared = mended(spark, [(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 0), (4, 0), (4, 2), (2, 2)])  # a shared edge goes
    assert [len(p) for p in shared] == [1] and abs(area_of(shared) - 8) < 1e-9


def test_what_is_no_polygon_goes(spark):
    rows = [(1, [[(0.0, 0.0), (1.0, 1.0)]]), (2, []), (3, None), (4, [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]), (5, [[(0.0, None), (1.0, 0.0), (1.0, 1.0)]]), (6, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None]), (7, [[(1.0, 1.0)] * 5])]
    frame = spark.createDataFrame(rows, f"id int, rings {repair.RINGS}").withColumn("polygons", F.lit("x"))
    assert [r["id"] for r in repair.valid_rows(frame, "rings").collect()] == [6]


def test_random_rings_keep_their_even_odd_area_and_are_simple(spark):
    rng = random.Random(2)
    x, y = np.meshgrid(np.arange(0.005, 10, 0.01), np.arange(0.005, 10, 0.01))
    for n in (5, 8, 12, 40):
        rings = [[(round(rng.uniform(0, 10), 3), round(rng.uniform(0, 10), 3)) for _ in range(n)] for _ in range(2)]
        found = mended(spark, *rings)
        want = parity(x, y, rings[0]) ^ parity(x, y, rings[1])
        got = np.zeros(x.shape, bool)
        for polygon in found:
            assert repair.signed_area(np.array(polygon[0])) > 0 and all(repair.signed_area(np.array(h)) < 0 for h in polygon[1:])
            for ring in polygon:
                assert len(set(ring)) == len(ring)
                got ^= parity(x, y, ring)
        assert (want != got).mean() < 1e-4
        again = repair.polygons([np.array(r) for p in found for r in p])
        assert len(again) == len(found) and abs(area_of(again) - area_of(found)) < 1e-6


@pytest.mark.parametrize(("lat", "km"), [(0.0, 0.1), (20.0, 10.0), (60.0, 300.0), (-35.0, 0.5)])
def test_circles_have_the_area_of_their_radius(spark, lat, km):
    frame = spark.createDataFrame([(1, (77.0, lat))], "g int, p struct<x: double, y: double>")
    ring = frame.select("g", F.lit(1).cast("long").alias("polygon"), F.lit("zone").alias("role"), buffers.circle(F.col("p"), F.lit(km)).alias("ring"))
    got = coverage.covered_km2(ring, ["g"], 5.0).first()["km2"]
    assert abs(got / buffers.circle_km2(km) - 1) < 1e-3
    assert abs(ring.select(area_km2(F.col("ring")).alias("a")).first()["a"] / buffers.circle_km2(km) - 1) < 1e-3


def near(x, y, ring, km):
    """Whether points of a plane around 20 degrees north lie within ``km`` of a ring or in it."""
    kx, ky = math.cos(math.radians(20.6)) * EARTH_KM * math.pi / 180, EARTH_KM * math.pi / 180
    out = parity(x, y, ring)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = (x1 - x0) * kx, (y1 - y0) * ky
        px, py = (x - x0) * kx, (y - y0) * ky
        t = np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0, 1)
        out |= np.hypot(px - t * dx, py - t * dy) <= km
    return out


def test_buffers_of_rings_less_their_core_equal_a_fine_grid(spark):
    concave = [(10.4, 20.4), (10.8, 20.4), (10.6, 20.55), (10.8, 20.8), (10.4, 20.8)]
    convex = [(10.4, 20.4), (10.8, 20.5), (10.7, 20.8), (10.5, 20.75)]
    frame = spark.createDataFrame([(1, concave), (2, convex)], "g int, core array<struct<x: double, y: double>>")
    km = F.lit(10.0)
    role = lambda d, r, ring: d.select("g", F.xxhash64(ring).alias("polygon"), F.lit(r).alias("role"), F.col(ring).alias("ring"))
    parts = role(buffers.buffer_parts(frame, "core", km), "zone", "part").unionByName(role(frame, "hole", "core"))
    one = frame.where("g = 2").withColumn("part", buffers.convex_buffer(F.col("core"), km))
    got = {r["g"]: r["km2"] for r in coverage.covered_km2(parts, ["g"], 0.25).collect()}
    single = coverage.covered_km2(role(one, "zone", "part").unionByName(role(one, "hole", "core")), ["g"], 0.25).first()["km2"]
    x, y = np.meshgrid(np.arange(10.2, 11.0, 0.001), np.arange(20.2, 21.0, 0.001))
    for g, ring in ((1, concave), (2, convex)):
        want = float(((near(x, y, ring, 10.0) & ~parity(x, y, ring)) * np.cos(np.radians(y))).sum()) * math.radians(0.001) ** 2 * EARTH_KM**2
        assert abs(got[g] / want - 1) < 4e-3
    assert abs(single / got[2] - 1) < 1e-3


def test_convex_buffers_of_few_corners(spark):
    for ring in ([(77.0, 20.0)], [(77.0, 20.0), (77.1, 20.0)]):
        out = spark.createDataFrame([(ring,)], "r array<struct<x: double, y: double>>").select(area_km2(buffers.convex_buffer(F.col("r"), F.lit(5.0))).alias("a")).first()["a"]
        want = math.pi * 25 + (len(ring) - 1) * 2 * 5 * math.cos(math.radians(20)) * EARTH_KM * math.radians(0.1)
        assert abs(out / want - 1) < 2e-3
