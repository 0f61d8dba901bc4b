"""Counts, nearest points and clusters against all pairs, and how few pairs they make."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM, haversine_km
from siteloom.operators import proximity


def apart(a, b):
    x, y = np.radians(np.array(a, float)), np.radians(np.array(b, float))
    h = np.sin((y[None, :, 1] - x[:, None, 1]) / 2) ** 2 + np.cos(x[:, None, 1]) * np.cos(y[None, :, 1]) * np.sin((y[None, :, 0] - x[:, None, 0]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


def scene(seed, n):
    rng = random.Random(seed)
    spots = [(rng.uniform(70, 75), rng.uniform(8, 37)) for _ in range(8)]
    out = [(rng.uniform(70, 76), rng.uniform(8, 37)) if rng.random() < 0.2 else tuple(rng.gauss(c, 0.15) for c in rng.choice(spots)) for _ in range(n)]
    return out + [out[0]] * 5


def frames(spark, sites, points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(sites)], "site int, lon double, lat double"), spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "mark int, plon double, plat double")


@pytest.mark.parametrize("radii", [[100.0, 25.0, 20.0], [3.0]])
def test_counts_equal_all_pairs(spark, radii):
    sites, points = scene(1, 40) + [(100.0, 0.0)], scene(2, 900)
    got = {r["site"]: tuple(r[f"n{x:g}"] for x in radii) for r in proximity.counts_within(*frames(spark, sites, points), radii).collect()}
    km = apart(sites, points)
    assert got == {i: tuple(int((km[i] <= r).sum()) for r in radii) for i in range(len(sites))}


@pytest.mark.parametrize("reach", [100.0, 5.0])
def test_nearest_equals_all_pairs(spark, reach):
    sites, points = scene(3, 60) + [(100.0, 0.0)], scene(4, 700)
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    got = {r["site"]: r["mark"] for r in proximity.nearest_within(*frames(spark, sites, points), reach, km, lambda r: r, ["mark"]).where(F.col("distance") <= reach).collect()}
    all_km = apart(sites, points)
    want = {}
    for i, row in enumerate(all_km):
        best = np.flatnonzero(np.isclose(row, row.min(), rtol=0, atol=1e-9))
        if row.min() <= reach:
            want[i] = int(best[0])
    assert got == want


def brute_clusters(points, km, least):
    near = apart(points, points) <= km
    core = near.sum(axis=1) >= least
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo = [i]
        label[i] = i
        while todo:
            for k in np.flatnonzero(near[todo.pop()] & core):
                if k not in label:
                    label[k] = i
                    todo.append(k)
    least_of = {}
    for k, root in label.items():
        least_of[root] = min(least_of.get(root, k), k)
    out = {int(k): int(least_of[root]) for k, root in label.items()}
    for i in np.flatnonzero(~core):
        found = [out[int(k)] for k in np.flatnonzero(near[i] & core)]
        if found:
            out[int(i)] = min(found)
    return out


@pytest.mark.parametrize(("km", "least"), [(60.0, 4), (8.0, 3), (20.0, 6)])
def test_clusters_equal_all_pairs(spark, km, least):
    points = scene(int(km), 500)
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lon double, lat double")
    assert {r["id"]: r["cluster"] for r in proximity.clusters(frame, km, least).collect()} == brute_clusters(points, km, least)


def test_cells_in_doubt_are_decided_by_their_points(spark):
    # Two groups whose nearest points are just within, then just beyond, ten kilometres of each other.
    for gap, one in ((0.0898, True), (0.0901, False)):
        a = [(77.0 - 0.001 * i, 20.0 - 0.0004 * i) for i in range(12)]
        b = [(77.0, 20.0 + gap + 0.0003 * i) for i in range(12)]
        km = apart(a, b).min()
        assert (km <= 10) == one and abs(km - 10) < 0.05
        frame = spark.createDataFrame([(i, *p) for i, p in enumerate(a + b)], "id int, lon double, lat double")
        got = {r["id"]: r["cluster"] for r in proximity.clusters(frame, 10.0, 4).collect()}
        assert got == brute_clusters(a + b, 10.0, 4) and (len(set(got.values())) == 1) == one


def rows_made(frame):
    """Rows that the joins of an executed plan made."""
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif "QueryStageExec" in kind:
            todo.append(node.plan())
        else:
            if "Join" in kind and node.metrics().contains("numOutputRows"):
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_dense_points_make_few_pairs(spark):
    rng = random.Random(9)
    points = [(77 + rng.gauss(0, 0.3), 20 + rng.gauss(0, 0.3)) for _ in range(4000)]
    sites = [(77 + rng.gauss(0, 0.2), 20 + rng.gauss(0, 0.2)) for _ in range(20)]
    pairs = len(points) * len(sites)
    assert (apart(sites, points) <= 100).sum() > 0.9 * pairs
    frame = frames(spark, sites, points)
    assert rows_made(proximity.counts_within(*frame, [100.0])) < 0.35 * pairs
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    assert rows_made(proximity.nearest_within(*frame, 100.0, km, lambda r: r, ["mark"])) < 0.05 * pairs
    assert math.isclose(proximity.counts_within(*frame, [100.0]).agg(F.sum("n100")).first()[0], int((apart(sites, points) <= 100).sum()))
