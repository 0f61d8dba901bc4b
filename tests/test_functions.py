"""Hand-computed values of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from siteloom.functions import finance, text, wind
from siteloom.functions.geo import haversine_km, segment_km
from siteloom.functions.numeric import half_up, piecewise
from siteloom.operators.graph import connected
from siteloom.operators.spatial import inside_ring, within_radius


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, digits, want", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 1, 1.0), (-0.15, 1, -0.1)])
def test_half_up(spark, value, digits, want):
    assert one(spark, half_up(F.lit(value), digits)) == pytest.approx(want)


@pytest.mark.parametrize("speed, want", [(3.0, 0.25), (4.25, 0.275), (7.5, 0.44), (12.0, 0.46)])
def test_cuf(spark, speed, want):
    assert one(spark, wind.cuf(F.lit(speed))) == pytest.approx(want)


def test_piecewise_of_nothing(spark):
    assert one(spark, piecewise(F.lit(None).cast("double"), [(0, 0), (1, 1)])) is None
    assert one(spark, piecewise(F.lit(float("nan")), [(0, 0), (1, 1)])) is None


def test_missing_distances_score(spark):
    assert one(spark, wind.grid_score(F.lit(None).cast("double"), F.lit(None).cast("double"))) == pytest.approx(0.15)
    assert one(spark, wind.grid_score(F.lit(2.0), F.lit(5.0))) == pytest.approx(1.0)


def test_irr(spark):
    flows = F.array(*[F.lit(x) for x in (-100.0, 60.0, 60.0)])
    assert one(spark, finance.irr(flows)) == pytest.approx(0.130662, abs=1e-6)
    assert one(spark, finance.irr(F.array(F.lit(1.0), F.lit(1.0)))) is None


def test_payback_and_npv(spark):
    flows = F.array(*[F.lit(x) for x in (-100.0, 60.0, 60.0)])
    assert one(spark, finance.first_year_paid(flows)) == 2
    assert one(spark, finance.npv(0.1, flows)) == pytest.approx(-100 + 60 / 1.1 + 60 / 1.21)


def test_distance(spark):
    assert one(spark, haversine_km(F.lit(77.0), F.lit(8.0), F.lit(77.0), F.lit(9.0))) == pytest.approx(6371.0088 * math.pi / 180)
    assert one(spark, segment_km(*[F.lit(x) for x in (0.0, 0.0, -1.0, 1.0, 1.0, 1.0)])) == pytest.approx(6371.0088 * math.pi / 180)


def test_inside_ring_does_not_depend_on_winding(spark):
    corners = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    for ring in (corners, corners[::-1]):
        column = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
        assert one(spark, inside_ring(F.lit(1.0), F.lit(1.0), column)) is True
        assert one(spark, inside_ring(F.lit(3.0), F.lit(1.0), column)) is False


def test_radius_join_equals_brute_force(spark):
    sites = spark.range(40).select(F.col("id").alias("site"), (F.lit(70.0) + F.col("id") * 0.31).alias("lon"), (F.lit(8.0) + F.pmod(F.col("id") * 7, F.lit(20))).cast("double").alias("lat"))
    points = spark.range(300).select(F.col("id").alias("p"), (F.lit(69.0) + F.pmod(F.col("id") * 37, F.lit(140)) / 10).alias("plon"), (F.lit(7.0) + F.pmod(F.col("id") * 53, F.lit(220)) / 10).alias("plat"))
    got = {(r["site"], r["p"]) for r in within_radius(sites, points, 80.0).collect()}
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    want = {(r["site"], r["p"]) for r in sites.crossJoin(points).where(km <= 80.0).collect()}
    assert got == want and want


def test_connected(spark):
    nodes = spark.range(10).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (8, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


@pytest.mark.parametrize("raw, want", [("2.5 MW", 2500.0), ("850kW", 850.0), ("900000", 900.0), ("1 GW", 1e6), ("none", None)])
def test_rated_power(spark, raw, want):
    assert one(spark, text.rated_kw(F.lit(raw))) == want


def test_voltage_and_rewrite(spark):
    assert one(spark, text.max_voltage(F.lit("33; abc;132.0;-5"))) == 132.0
    assert one(spark, text.mended(text.with_states(F.lit("masts in MP or gujrat, not AMP")))) == "masts in Madhya Pradesh or Gujarat, not AMP"
    assert one(spark, text.strip_html(F.lit("<p>a &amp; b</p><script>x</script>"))) == "a & b"


def test_global_rank_equals_sorting(spark):
    from siteloom.operators.ranking import global_rank

    df = spark.range(200).select(F.col("id").alias("site"), F.when(F.col("id") % 17 != 0, F.pmod(F.col("id") * 31, F.lit(7)).cast("int")).alias("score"))
    got = [(r["score"], r["site"]) for r in global_rank(df, "score", "site", 16).orderBy("rank").collect()]
    rows = [(r["score"], r["site"]) for r in df.collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


def test_convex_hulls_equal_the_hull_of_all_points(spark):
    import numpy as np

    from siteloom.operators.shapes import convex_hulls, hull

    df = spark.range(0, 400, 1, 6).select((F.col("id") % 3).alias("k"), (F.pmod(F.col("id") * 7919, F.lit(101))).cast("double").alias("x"), (F.pmod(F.col("id") * 104729, F.lit(89))).cast("double").alias("y"))
    rows = df.toPandas()
    got = convex_hulls(df, "k", "x", "y").toPandas()
    for k, own in rows.groupby("k"):
        want = hull(own[["x", "y"]].to_numpy())
        assert np.array_equal(got[got["k"] == k].sort_values("corner")[["x", "y"]].to_numpy(), want)
        for (x1, y1), (x2, y2) in zip(want, np.roll(want, -1, axis=0), strict=True):
            assert ((x2 - x1) * (own["y"] - y1) - (y2 - y1) * (own["x"] - x1) >= 0).all()


def test_geohash_of_a_known_place(spark):
    from siteloom.operators.shapes import geohash

    assert one(spark, geohash(F.lit(-5.6), F.lit(42.6), 5)) == "ezs42"


def test_simplify_keeps_what_sticks_out(spark):
    from siteloom.operators.shapes import simplify

    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0], [0.0, 0.001, 1.0, 0.0, 0.0]), ([0.0, 1.0], [0.0, 0.0]), ([], [])], "x array<double>, y array<double>")
    assert [r["p"] for r in df.select(simplify(F.col("x"), F.col("y"), 0.01).alias("p")).collect()] == [[0, 1, 2, 3, 4], [0, 1], []]
    assert [r["p"] for r in df.select(simplify(F.col("x"), F.col("y"), 0.6).alias("p")).collect()][0] == [0, 2, 4]


def test_clipping_is_exact_on_convex_and_other_rings(spark):
    from pyspark.sql import functions as F

    from siteloom.operators.shapes import clipped

    window = [(0.0, 0.0), (4.0, 0.0), (5.0, 3.0), (1.0, 4.0)]
    rings = {"inside": [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], "around": [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)], "apart": [(8.0, 8.0), (9.0, 8.0), (9.0, 9.0)], "notched": [(-1.0, 1.0), (3.0, 1.0), (1.0, 1.5), (3.0, 2.0), (-1.0, 2.0)]}
    xy = "array<struct<x: double, y: double>>"
    rows = spark.createDataFrame([(k, r, window) for k, r in rings.items()], f"name string, ring {xy}, window {xy}")
    got = {r["name"]: [(p["x"], p["y"]) for p in r["cut"]] for r in rows.select("name", clipped(F.col("ring"), F.col("window")).alias("cut")).collect()}
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], *r[:1]], strict=True))) / 2
    assert area(got["inside"]) == area(rings["inside"]) and abs(area(got["around"]) - area(window)) < 1e-12 and got["apart"] == []
    inside = lambda p, r: sum(((a[1] > p[1]) != (b[1] > p[1])) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, [*r[1:], *r[:1]], strict=True)) % 2 == 1
    steps = [(i + 0.5) / 100 for i in range(-150, 450)]
    counted = sum(inside((x, y), rings["notched"]) and inside((x, y), window) for x in steps for y in steps if 0.9 < y < 2.1) / 1e4
    assert abs(area(got["notched"]) - counted) < 0.02


def test_links_of_areas_read_back(spark):
    from pyspark.sql import functions as F

    from siteloom.functions import labels

    ring = [(77.123456, 8.5), (78.0, 8.5), (78.0, 9.0), (77.123456, 9.0)]
    rows = spark.createDataFrame([(ring,)], "ring array<struct<x: double, y: double>>").withColumn("link", labels.permalink(F.col("ring")))
    row = rows.select(
        "link", labels.ring_of(F.col("link")).alias("back"), labels.ring_of(F.lit("#aoi=0!!")).alias("none"), labels.ring_of(labels.inflated(labels.deflated(F.col("link")))).alias("again"), labels.inflated(F.lit("aoi=1zzzz")).alias("bad")
    ).first()
    assert [tuple(p) for p in row["back"]] == ring == [tuple(p) for p in row["again"]] and row["none"] is None and row["bad"] is None


def test_mast_labels_give_place_names(spark):
    from pyspark.sql import functions as F

    from siteloom.functions import labels

    want = {"Aladar150m Jul24-Jun25_Pvt. Mast": ("Aladar", 150), "Ratkuriya-V_Pvt. WM_65m": ("Ratkuriya-V", 65), "Jura CECL_65m_WM_June2010-May2013": ("Jura", 65), "Mast-1_80m_Pvt. Mast": ("Mast-1", 80), "_Pvt. WM-Humbarne": ("Humbarne", None), "Sri Palvan-1 Dec09": ("Sri Palvan-1", None), "Guttaseema Wind": ("Guttaseema Wind", None), "Mayurbhanj 5m": ("Mayurbhanj 5m", None)}
    rows = spark.createDataFrame([(k,) for k in want], "label string")
    got = {r["label"]: (r["name"], r["h"]) for r in rows.select("label", labels.display_name(F.col("label")).alias("name"), labels.height_m(F.col("label")).alias("h")).collect()}
    assert got == want


def test_quantiles_are_exact_with_repeats(spark):
    import random

    import numpy as np

    from siteloom.operators.ranking import quantiles

    rng = random.Random(3)
    values = [float(rng.choice([1.5, 1.5, 7.25, rng.uniform(-50, 900)])) for _ in range(700)] + [5e6]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.25, 0.333, 0.5, 0.999, 1.0]
    got = {r["share"]: r["v"] for r in quantiles(rows, "v", shares).collect()}
    assert all(abs(got[s] - np.percentile(values, s * 100)) < 1e-6 for s in shares)
    same = {r["share"]: r["v"] for r in quantiles(spark.createDataFrame([(2.0,)] * 5, "v double"), "v", [0.0, 0.5, 1.0]).collect()}
    assert set(same.values()) == {2.0} and len(same) == 3


@pytest.mark.parametrize("most", [50_000, 2])
def test_needles_are_found_wherever_they_stand(spark, monkeypatch, most):
    from siteloom.operators import search

    monkeypatch.setattr(search, "MOST_NEEDLES", most)
    long = "x" * 40
    needles = [(1, "ab"), (2, "aba"), (3, ""), (4, long + "1"), (5, long + "2"), (6, "ab"), (7, None)]
    texts = [(1, "cababa"), (2, "xx" + long + "2"), (3, None), (4, ""), (5, long)]
    got = {tuple(r) for r in search.holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "item long, needle string")).collect()}
    assert got == {(i, t) for i, n in needles for t, x in texts if n is not None and x is not None and n in x}


def test_quantiles_hold_for_outliers_and_by_group(spark):
    import numpy as np
    from siteloom.operators import ranking

    rng = np.random.default_rng(4)
    values = {"a": [*rng.random(20000), 1e18], None: [*rng.integers(0, 50, 3000).astype(float)], "b": [7.0]}
    rows = spark.createDataFrame([(g, float(v)) for g, own in values.items() for v in own] + [("b", None), ("c", None)], "g string, v double").repartition(8)
    shares = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["share"]): r["v"] for r in ranking.quantiles(rows, "v", shares, "g").collect()}
    assert set(got) == {(g, s) for g in values for s in shares}
    for g, own in values.items():
        assert np.allclose([got[(g, s)] for s in shares], np.quantile(own, shares), rtol=1e-12)
    # No task holds most of the values, though all but one lie in a stretch of 1e-18 of their range.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one task
    try:
        placed = ranking.ranked(rows.where("g = 'a'").groupBy("v").count().withColumnRenamed("count", "n"), None, ["v"], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(placed._staged_at).groupBy("part").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 0.6 * 20001
