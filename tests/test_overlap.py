"""Squares that share a part, held to their pairs: the fourth round's finding."""

import numpy as np
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM
from siteloom.operators.overlap import shared_each, squares_overlap
from siteloom.plans import catalog
from tests.test_proximity import rows_made
from tests.test_queries import DATA, pytestmark  # noqa: F401
from tests.test_round3 import same  # noqa: F401


def pairs(lon, lat, zx, zy, times, half_area, half_zone):
    dx, y0, y1 = (np.minimum(lon[:, None] + half_area, zx + half_zone) - np.maximum(lon[:, None] - half_area, zx - half_zone), np.maximum(lat[:, None] - half_area, zy - half_zone), np.minimum(lat[:, None] + half_area, zy + half_zone))
    met = (dx > 0) & (y1 > y0)
    return (met * times).sum(axis=1), (np.where(met, EARTH_KM**2 * np.radians(dx) * (np.sin(np.radians(y1)) - np.sin(np.radians(y0))), 0) * times).sum(axis=1)


def test_sums_over_boxes_are_those_over_pairs():
    rng = np.random.default_rng(2)
    for n, m, half_zone in ((1, 1, 0.15), (2, 3, 0.2), (700, 90, 0.15), (1025, 40, 0.05)):
        at = [rng.integers(0, 1500, k) / 1000 + start for k, start in ((m, 80), (m, 20), (n, 80), (n, 20))]  # on a lattice: sides touch, and middles are alike
        times = rng.integers(1, 5, n)
        count, km2 = shared_each(*at, times, 0.2, half_zone)
        want, area = pairs(*at, times, 0.2, half_zone)
        assert (count == want).all() and np.allclose(km2, area, rtol=1e-12, atol=1e-8)


def squares(spark, n, m):
    areas = spark.range(m).select(F.col("id").alias("site"), (80 + F.pmod("id", F.lit(97)) / 500.0).alias("lon"), (20 + F.pmod("id", F.lit(89)) / 500.0).alias("lat"))
    zones = spark.range(n).select(F.concat(F.lit("c"), F.col("id") % 2).alias("class"), (79.9 + F.pmod(F.col("id") * 7, F.lit(983)) / 2500.0).alias("zx"), (19.9 + F.pmod(F.col("id") * 13, F.lit(991)) / 2500.0).alias("zy"))
    return areas, zones


def test_blocks_of_a_crowded_cell_add_up(spark):
    areas, zones = squares(spark, 300, 70)
    areas = areas.unionByName(spark.createDataFrame([(900, None, 20.0), (901, 80.0, None), (902, 10.0, 20.0)], areas.schema))
    zones = zones.unionByName(zones.limit(20)).unionByName(spark.createDataFrame([("c0", None, 20.0), ("c1", 80.0, None), (None, 80.0, 20.0)], zones.schema))
    a, z = areas.where("lon IS NOT NULL AND lat IS NOT NULL").toPandas(), zones.where("zx IS NOT NULL AND zy IS NOT NULL").toPandas()
    want = {}
    for kind in ("c0", "c1", None):
        own = z[z["class"].isna() if kind is None else z["class"] == kind]
        count, km2 = pairs(*(x.to_numpy() for x in (a["lon"], a["lat"], own["zx"], own["zy"])), np.ones(len(own), int), 0.2, 0.15)
        want |= {(s, kind): (int(n), float(k)) for s, n, k in zip(a["site"].tolist(), count, km2, strict=True) if n}
    for block in (1 << 15, 16):
        got = {(r["site"], r["class"]): (r["zones"], r["km2"]) for r in squares_overlap(areas, zones, 0.2, 0.15, block).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and all(np.isclose(got[k][1], km2, rtol=1e-12) for k, (_, km2) in want.items())
    assert squares_overlap(areas.limit(0), zones, 0.2, 0.15).count() == squares_overlap(areas, zones.limit(0), 0.2, 0.15).count() == 0


def test_overlaps_are_summed_up_without_their_pairs(spark):
    areas, zones = squares(spark, 4000, 400)
    found = squares_overlap(areas, zones, 0.2, 0.15)
    assert found.agg(F.sum("zones")).first()[0] > 1_000_000 and rows_made(found) < 50_000


def test_the_query_makes_no_row_for_a_zone_and_its_area(spark, same, tmp_path):
    """Places repeat every 992,000 keys: 200 areas in one place and 500 zones in another meet."""
    k = np.arange(1, 992_000)
    near = (abs(k * 7919 % 31000 - 4 * 7919 % 31000) < 200) & (abs(k * 10473 % 32000 - 7 * 10473 % 32000) < 200)  # of zone 1
    many = lambda t, key, first, n: f"SELECT t.* REPLACE ({first} + r.k * 992000 AS {key}) FROM (SELECT * FROM '{DATA}/{t}.parquet' LIMIT 1) t, range({n}) r(k)"
    assert same("exclusion_overlap", supplier=many("supplier", "s_suppkey", int(k[near][0]), 200), customer=many("customer", "c_custkey", 1, 500)) == 200
    found = catalog.queries()["exclusion_overlap"](spark, str(tmp_path))
    assert found.agg(F.sum("zones")).first()[0] == 100_000 and rows_made(found) < 5000
