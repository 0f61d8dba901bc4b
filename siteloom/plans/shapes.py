"""Areas of interest, geohashes, hulls, and small statistics over points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.geo import sql_lat, sql_lon, synthetic_lat, synthetic_lon
from siteloom.functions.numeric import half_up
from siteloom.operators import shapes
from siteloom.operators.ranking import quantiles
from siteloom.plans.tables import table

# Corner offsets, in degrees, of the shapes that the sample areas take in turn: a square, a bow tie, a line, a square with repeats, one too large, one too small.
SHAPES = [
    [(0.0, 0.0), (0.05, 0.0), (0.05, 0.05), (0.0, 0.05), (0.0, 0.0)], [(0.0, 0.0), (0.1, 0.1), (0.1, 0.0), (0.0, 0.1), (0.0, 0.0)], [(0.0, 0.0), (0.1, 0.1)],
    [(0.0, 0.0), (0.0, 0.0), (0.08, 0.0), (0.08, 0.0), (0.08, 0.08), (0.0, 0.08)], [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)], [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001)],
]


def aoi_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical vertices, area and first broken rule of every sample area."""
    k = F.col("c_custkey")
    lon, lat = synthetic_lon(k), synthetic_lat(k * 3)
    ring = F.array().cast("array<struct<x: double, y: double>>")
    for i, shape in enumerate(SHAPES):
        ring = F.when(k % len(SHAPES) == i, F.array(*[F.struct((lon + dx).alias("x"), (lat + dy).alias("y")) for dx, dy in shape])).otherwise(ring)
    rows = table(spark, sf_dir, "customer").select(k.alias("area"), ring.alias("raw")).withColumn("ring", shapes.canonical(F.col("raw")))
    return rows.select("area", F.size("ring").alias("vertices"), half_up(shapes.area_km2(F.col("ring")), 3).alias("km2"), shapes.error_code(F.col("raw"), F.col("ring")).alias("error"))


def _shape_sql(shape: list[tuple[float, float]]) -> str:
    return "[" + ", ".join(f"{{'x': lon + {dx!r}::DOUBLE, 'y': lat + {dy!r}::DOUBLE}}" for dx, dy in shape) + "]"


AOI_SQL = f"""
WITH c AS (SELECT c_custkey AS area, {sql_lon('c_custkey')} AS lon, {sql_lat('c_custkey * 3')} AS lat FROM customer),
r AS (SELECT area, CASE area % 6 {' '.join(f'WHEN {i} THEN {_shape_sql(s)}' for i, s in enumerate(SHAPES))} END AS raw FROM c),
p AS (SELECT area, len(raw) AS given, i, floor(raw[i].x * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS x, floor(raw[i].y * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS y FROM r, range(1, 8) AS t(i) WHERE i <= len(raw)),
o AS (SELECT *, lag((x, y)) OVER (PARTITION BY area ORDER BY i) AS before FROM p),
f AS (SELECT *, first((x, y)) OVER w AS f, last((x, y)) OVER w AS l, max(i) OVER w AS n FROM (SELECT * FROM o WHERE before IS NULL OR before <> (x, y)) WINDOW w AS (PARTITION BY area ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY i) AS k, count(*) OVER (PARTITION BY area) AS vertices FROM f WHERE NOT (i = n AND f = l AND i > 1)),
e AS (SELECT a.area, a.given, a.k, a.vertices, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.area = b.area AND b.k = a.k % a.vertices + 1),
x AS (SELECT a.area FROM e a JOIN e b ON a.area = b.area AND b.k >= a.k + 2 AND NOT (a.k = 1 AND b.k = b.vertices)
  WHERE sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
    AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0),
s AS (SELECT area, max(given) AS given, CAST(max(vertices) AS INT) AS vertices, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6371.0088::DOUBLE * 6371.0088::DOUBLE / 2 AS km2, bool_or(x1 < 67 OR x1 > 98 OR y1 < 6 OR y1 > 38) AS outside FROM e GROUP BY area)
SELECT area, vertices, floor(km2 * 1000 + 0.5) / 1000 AS km2, CASE WHEN given < 3 THEN 'too_few_vertices' WHEN vertices < 3 THEN 'degenerate' WHEN area IN (SELECT area FROM x) THEN 'self_intersection'
  WHEN km2 < 1 THEN 'too_small' WHEN km2 > 2500 THEN 'too_large' WHEN outside THEN 'outside' END AS error FROM s
"""


def geohash_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masts by geohash of five letters, with the least full hash of each."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(shapes.geohash(synthetic_lon(k * 3 + 1), synthetic_lat(k * 5 + 2), 8).alias("hash"))
    return rows.groupBy(F.substring("hash", 1, 5).alias("cell")).agg(F.count("*").alias("masts"), F.min("hash").alias("first"))


def _geohash_sql(lon: str, lat: str, length: int) -> str:
    bit = lambda i: f"(({'x' if i % 2 == 0 else 'y'} >> {29 - i // 2}) & 1)"
    letters = [f"substr('{shapes.ALPHABET}', CAST(1 + {' + '.join(f'{bit(at + k)} * {1 << (4 - k)}' for k in range(5))} AS INT), 1)" for at in range(0, length * 5, 5)]
    return f"SELECT {' || '.join(letters)} AS hash FROM (SELECT CAST(floor(({lon} + 180) / 360 * 1073741824::DOUBLE) AS BIGINT) AS x, CAST(floor(({lat} + 90) / 180 * 1073741824::DOUBLE) AS BIGINT) AS y FROM customer)"


GEOHASH_SQL = f"SELECT substr(hash, 1, 5) AS cell, count(*) AS masts, min(hash) AS first FROM ({_geohash_sql(sql_lon('c_custkey * 3 + 1'), sql_lat('c_custkey * 5 + 2'), 8)}) GROUP BY 1"


def layout_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull of each nation's masts: its corners, area and middle; in whole thousandths of a degree, so that points in line are told exactly."""
    k = F.col("c_custkey")
    masts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(synthetic_lon(k * 3 + 1) * 1000 + 0.5).alias("x"), F.floor(synthetic_lat(k * 5 + 2) * 1000 + 0.5).alias("y"))
    corners = shapes.convex_hulls(masts, "nation", "x", "y").withColumns({"x": F.col("x") / 1000, "y": F.col("y") / 1000})
    rings = corners.groupBy("nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rings.select("nation", F.size("ring").alias("corners"), half_up(shapes.area_km2(F.col("ring")), 2).alias("km2"), half_up(F.col("x"), 4).alias("x"), half_up(F.col("y"), 4).alias("y"))


def quantile_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """101 quantiles of all valid pixels at three decimals."""
    found = quantiles(table(spark, sf_dir, "part").where("p_retailprice > 0"), "p_retailprice", [i / 100 for i in range(101)])
    return found.select(F.floor(F.col("share") * 100 + 0.5).cast("int").alias("percent"), half_up(F.col("p_retailprice"), 3).alias("value"))


QUANTILE_SQL = """
WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part WHERE p_retailprice > 0),
q AS (SELECT CAST(k AS INT) AS percent, k / 100.0::DOUBLE * ((SELECT max(n) FROM s) - 1) AS pos FROM range(101) AS t(k))
SELECT percent, floor((a.v + (b.v - a.v) * (pos - floor(pos))) * 1000 + 0.5) / 1000 AS value FROM q JOIN s a ON a.i = CAST(floor(pos) AS BIGINT) JOIN s b ON b.i = CAST(ceil(pos) AS BIGINT)
"""


def elevation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand: median, mean and 90th-percentile gap between two heights of a part, and the part with the largest."""
    gap = F.abs(F.col("p_size") * 20 - F.col("p_retailprice"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", gap.alias("gap"))
    found = quantiles(rows, "gap", [0.5, 0.9], "p_brand").groupBy("p_brand").agg(*[half_up(F.max(F.when(F.col("share") == s, F.col("gap"))), 3).alias(n) for s, n in ((0.5, "median"), (0.9, "p90"))])
    sums = rows.groupBy("p_brand").agg(F.count("*").alias("n"), half_up(F.avg("gap"), 3).alias("mean"), F.max_by("p_partkey", F.struct("gap", -F.col("p_partkey"))).alias("worst"))
    return sums.join(found, "p_brand").select("p_brand", "n", "median", "mean", "p90", "worst")


ELEVATION_SQL = """
SELECT p_brand, count(*) AS n, floor(quantile_cont(gap, 0.5) * 1000 + 0.5) / 1000 AS median, floor(avg(gap) * 1000 + 0.5) / 1000 AS mean, floor(quantile_cont(gap, 0.9) * 1000 + 0.5) / 1000 AS p90, arg_max(p_partkey, (gap, -p_partkey)) AS worst
FROM (SELECT *, abs(p_size * 20 - p_retailprice) AS gap FROM part) GROUP BY p_brand
"""


def component_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity by component of makers that make several, and in how many nations."""
    makes = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("blade"), F.lit("tower"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("nacelle"))).otherwise(F.array(F.lit("tower"), F.lit("hub"), F.lit("blade")))
    rows = table(spark, sf_dir, "supplier").select(F.explode(makes).alias("component"), "s_acctbal", "s_nationkey")
    return rows.groupBy("component").agg(F.count("*").alias("makers"), half_up(F.sum("s_acctbal"), 2).alias("capacity"), F.countDistinct("s_nationkey").alias("nations"))


COMPONENT_SQL = """
SELECT component, count(*) AS makers, floor(sum(s_acctbal) * 100 + 0.5) / 100 AS capacity, count(DISTINCT s_nationkey) AS nations FROM (
  SELECT unnest(CASE s_suppkey % 3 WHEN 0 THEN ['blade', 'tower'] WHEN 1 THEN ['nacelle'] ELSE ['tower', 'hub', 'blade'] END) AS component, s_acctbal, s_nationkey FROM supplier) GROUP BY 1
"""

def zone_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each zone class by map, from their colours."""
    k = F.col("p_partkey")
    r, g, b = F.pmod(k * 37, F.lit(256)), F.pmod(k * 59, F.lit(256)), F.pmod(k * 83, F.lit(256))
    rows = table(spark, sf_dir, "part").select("p_brand", shapes.zone_class(r, g, b).alias("class")).where("class IS NOT NULL")
    return rows.groupBy("p_brand", "class").agg(F.count("*").alias("pixels"))


ZONE_SQL = """
SELECT p_brand, class, count(*) AS pixels FROM (
  SELECT p_brand, CASE WHEN r >= greatest(g, b) + 60 AND r >= 120 THEN 'red' WHEN r >= 170 AND g >= 170 AND b <= 130 THEN 'amber' WHEN g >= 110 AND g >= r + 25 AND b <= 130 AND g >= b + 40 THEN 'green' END AS class
  FROM (SELECT p_brand, p_partkey * 37 % 256 AS r, p_partkey * 59 % 256 AS g, p_partkey * 83 % 256 AS b FROM part)) WHERE class IS NOT NULL GROUP BY 1, 2
"""

QUERIES = {f.__name__: f for f in (aoi_validation, geohash_cells, layout_footprint, quantile_artifact, elevation_check, component_capacity, zone_pixels)}
SQL = {"aoi_validation": AOI_SQL, "geohash_cells": GEOHASH_SQL, "quantile_artifact": QUANTILE_SQL, "elevation_check": ELEVATION_SQL, "component_capacity": COMPONENT_SQL, "zone_pixels": ZONE_SQL}
