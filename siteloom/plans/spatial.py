"""Spatial queries: radius, nearest, rings, polygons, tiles, rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM, haversine_km, segment_km, sql_haversine, sql_lat, sql_lon, synthetic_lat, synthetic_lon, tile_x, tile_y
from siteloom.functions.numeric import half_up
from siteloom.operators.proximity import counts_within, nearest_within
from siteloom.operators.ranking import quantiles
from siteloom.operators.spatial import around, cell_degrees, cells, nearest, points_in_rings, within_radius
from siteloom.plans.tables import table


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), synthetic_lon(k).alias("lon"), synthetic_lat(k).alias("lat"))


def _masts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("mast"), synthetic_lon(k * 3 + 1).alias("plon"), synthetic_lat(k * 5 + 2).alias("plat"), "c_acctbal")


SITES = f"SELECT s_suppkey AS site, {sql_lon('s_suppkey')} AS lon, {sql_lat('s_suppkey')} AS lat FROM supplier"
MASTS = f"SELECT c_custkey AS mast, {sql_lon('c_custkey * 3 + 1')} AS plon, {sql_lat('c_custkey * 5 + 2')} AS plat, c_acctbal FROM customer"
KM = sql_haversine("lon", "lat", "plon", "plat")


def masts_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masts within 100, 25 and 20 km of each site, in one pass."""
    sites = _sites(spark, sf_dir)
    confidence = F.when(F.col("n20") >= 2, "high").when(F.col("n25") >= 1, "medium").otherwise("low")
    return counts_within(sites, _masts(spark, sf_dir), [100.0, 25.0, 20.0]).select("site", "n100", "n25", "n20", confidence.alias("confidence"))


WITHIN_SQL = f"""
WITH p AS (SELECT site, {KM} AS km FROM ({SITES}), ({MASTS})),
c AS (SELECT site, count(*) FILTER (km <= 100) AS n100, count(*) FILTER (km <= 25) AS n25, count(*) FILTER (km <= 20) AS n20 FROM p GROUP BY site)
SELECT *, CASE WHEN n20 >= 2 THEN 'high' WHEN n25 >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM c
"""


def nearest_mast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mast within 100 km that is nearest on the plane of degrees, with its distance on the sphere."""
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    plane = (F.col("plon") - F.col("lon")) * (F.col("plon") - F.col("lon")) + (F.col("plat") - F.col("lat")) * (F.col("plat") - F.col("lat"))
    # What lies within r km holds all within r km of degrees at their widest; out of reach counts as infinitely far.
    seen = lambda r: (r / (EARTH_KM * math.pi / 180) * 0.999) ** 2
    best = nearest_within(_sites(spark, sf_dir), _masts(spark, sf_dir), 100.0, F.when(km <= 100, plane).otherwise(F.lit(float("inf"))), seen, ["mast", km.alias("km")])
    return best.where(F.col("distance") < float("inf")).select("site", "mast", half_up(F.col("km"), 3).alias("km"))


NEAREST_SQL = f"""
SELECT site, mast, floor(km * 1000 + 0.5) / 1000 AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY (plon - lon) * (plon - lon) + (plat - lat) * (plat - lat), mast) AS n
  FROM (SELECT *, {KM} AS km FROM ({SITES}), ({MASTS})) WHERE km <= 100) WHERE n = 1
"""


def mast_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a site's modelled speed lies from its nearest mast's within 25 km, brought to 100 m by the shear law."""
    masts = _masts(spark, sf_dir).withColumns({"height": (F.pmod("mast", F.lit(5)) * 20).cast("double"), "speed": F.when(F.col("mast") % 8 != 0, F.lit(4.0) + F.pmod(F.col("mast") * 7, F.lit(50)) / F.lit(10.0))})
    usable = masts.where((F.col("height") > 0) & F.col("speed").isNotNull())
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    best = nearest_within(_sites(spark, sf_dir), usable, 25.0, km, lambda r: r * 0.999, ["mast", "speed", "height"]).where("distance <= 25").withColumnRenamed("distance", "km")
    at_100 = F.col("speed") * F.pow(F.lit(100.0) / F.col("height"), F.lit(1 / 7))
    model = F.lit(5.0) + F.pmod("site", F.lit(30)) / F.lit(10.0)
    return best.select("site", "mast", half_up(F.col("km"), 3).alias("km"), half_up(at_100, 4).alias("mast_speed"), half_up((model - at_100) * 100 / at_100, 3).alias("delta_percent"))


VALIDATION_SQL = f"""
SELECT site, mast, floor(km * 1000 + 0.5) / 1000 AS km, floor(v * 10000 + 0.5) / 10000 AS mast_speed, floor((5.0::DOUBLE + (site % 30) / 10.0::DOUBLE - v) * 100 / v * 1000 + 0.5) / 1000 AS delta_percent FROM (
  SELECT *, (4.0::DOUBLE + (mast * 7 % 50) / 10.0::DOUBLE) * pow(100.0::DOUBLE / (mast % 5 * 20), 1 / 7.0::DOUBLE) AS v, row_number() OVER (PARTITION BY site ORDER BY km, mast) AS n
  FROM (SELECT *, {KM} AS km FROM ({SITES}), ({MASTS})) WHERE km <= 25 AND mast % 5 > 0 AND mast % 8 <> 0) WHERE n = 1
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ax, ay = synthetic_lon(k * 3), synthetic_lat(k * 7)
    volts = F.element_at(F.array(*[F.lit(v) for v in (66, 132, 220, 400)]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("line"), ax.alias("ax"), ay.alias("ay"), (ax + F.pmod(k, F.lit(11)) / F.lit(100.0)).alias("bx"), (ay + F.pmod(k, F.lit(13)) / F.lit(200.0)).alias("by"), volts.alias("kv"))


LINES = f"""SELECT o_orderkey AS line, {sql_lon('o_orderkey * 3')} AS ax, {sql_lat('o_orderkey * 7')} AS ay, {sql_lon('o_orderkey * 3')} + (o_orderkey % 11) / 100.0::DOUBLE AS bx,
  {sql_lat('o_orderkey * 7')} + (o_orderkey % 13) / 200.0::DOUBLE AS bly, [66, 132, 220, 400][CAST(o_orderkey % 4 + 1 AS INT)] AS kv FROM orders"""


def nearest_line_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest power line within 50 km of each site, and whether high voltage lies within 25 km.

    A line is at most 0.1 degrees long, so a cell that spans 50 km and that
    length around its start holds every line in reach.
    """
    sites, lines = _sites(spark, sf_dir), _lines(spark, sf_dir)
    km = segment_km(*[F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by")])
    # Distances are on a plane at the site: off by less than a hundredth in reach.
    near = lambda some, reach: nearest_within(sites, some, reach, km, lambda r: r * 0.99, ["line", "kv"], ("ax", "ay"), 0.1).where(F.col("distance") <= reach)
    high = near(lines.where("kv >= 220"), 25.0).select("site", F.lit(True).alias("high"))
    return near(lines, 50.0).join(high, "site", "left").select("site", "line", half_up(F.col("distance"), 3).alias("km"), "kv", F.coalesce("high", F.lit(False)).alias("high_voltage"))


def _segment_sql() -> str:
    return f"""SELECT *, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS km FROM (
  SELECT *, CASE WHEN x2 = x1 AND y2 = y1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t FROM (
  SELECT site, line, kv, (ax - lon) * cos(radians(lat)) * c AS x1, (ay - lat) * c AS y1, (bx - lon) * cos(radians(lat)) * c AS x2, (bly - lat) * c AS y2
  FROM ({SITES}), ({LINES}), (SELECT 6371.0088::DOUBLE * pi() / 180 AS c)))"""


LINE_SQL = f"""
SELECT site, line, floor(km * 1000 + 0.5) / 1000 AS km, kv, high_voltage FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, line) AS n, bool_or(kv >= 220 AND km <= 25) OVER (PARTITION BY site) AS high_voltage
  FROM ({_segment_sql()}) WHERE km <= 50) WHERE n = 1
"""

RINGS_KM = (10.0, 25.0, 50.0, 100.0)


def ring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masts found by widening rings, stopping at the first ring in which both kinds of mast have appeared."""
    kind = F.pmod("mast", F.lit(5)) == 0
    n = counts_within(_sites(spark, sf_dir), _masts(spark, sf_dir), list(RINGS_KM), {"sub": kind, "line": ~kind})
    last = len(RINGS_KM) - 1
    stop, subs, lines = F.lit(last), F.col(f"sub{RINGS_KM[-1]:g}"), F.col(f"line{RINGS_KM[-1]:g}")
    for i, km in reversed(list(enumerate(RINGS_KM[:-1]))):
        sub, line = F.col(f"sub{km:g}"), F.col(f"line{km:g}")
        both = (sub > 0) & (line > 0)
        stop, subs, lines = (F.when(both, now).otherwise(later) for now, later in ((F.lit(i), stop), (sub, subs), (line, lines)))
    return n.where(F.col(f"sub{RINGS_KM[-1]:g}") + F.col(f"line{RINGS_KM[-1]:g}") > 0).select("site", stop.alias("stop"), subs.alias("subs"), lines.alias("lines"))


RING_SQL = f"""
WITH p AS (
  SELECT site, mast % 5 = 0 AS sub, CASE WHEN km <= 10 THEN 0 WHEN km <= 25 THEN 1 WHEN km <= 50 THEN 2 ELSE 3 END AS ring FROM (SELECT *, {KM} AS km FROM ({SITES}), ({MASTS})) WHERE km <= 100
), f AS (
  SELECT site, CASE WHEN min(ring) FILTER (sub) IS NULL OR min(ring) FILTER (NOT sub) IS NULL THEN 3 ELSE greatest(min(ring) FILTER (sub), min(ring) FILTER (NOT sub)) END AS stop FROM p GROUP BY site
)
SELECT site, stop, count(*) FILTER (sub) AS subs, count(*) FILTER (NOT sub) AS lines FROM p JOIN f USING (site) WHERE ring <= stop GROUP BY site, stop
"""


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as areas of interest: a diamond around a point, as a closed ring."""
    k = F.col("n_nationkey")
    x, y, r = synthetic_lon(k * 101), synthetic_lat(k * 103), F.lit(1.0) + F.pmod(k, F.lit(4))
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, sf_dir, "nation").select(k.alias("area"), x.alias("x"), y.alias("y"), r.alias("r"), F.array(corner(x - r, y), corner(x, y - r), corner(x + r, y), corner(x, y + r), corner(x - r, y)).alias("ring"))


AREAS = f"SELECT n_nationkey AS area, {sql_lon('n_nationkey * 101')} AS x, {sql_lat('n_nationkey * 103')} AS y, 1.0::DOUBLE + n_nationkey % 4 AS r FROM nation"


def _turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("turbine"), synthetic_lon(k * 11).alias("plon"), synthetic_lat(k * 17).alias("plat"), F.when(k % 3 != 0, F.col("p_size") * 100).alias("kw"), "p_brand", "p_type")


TURBINES = f"SELECT p_partkey AS turbine, {sql_lon('p_partkey * 11')} AS plon, {sql_lat('p_partkey * 17')} AS plat, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 100 END AS kw, p_brand, p_type FROM part"
IN_AREA = "abs(plon - x) + abs(plat - y) < r"
BORDER = 1e-9  # degrees from an edge within which the formula decides


def in_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of a point and an area that holds it: what the ring holds, and on its border, where many round degrees lie, what the area's formula says."""
    return points_in_rings(points, areas, "ring", 1.0, BORDER).where(IN_AREA)


def turbines_in_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbines in each area: how many, how many rated, and their megawatts (null if none is rated)."""
    met = in_areas(_turbines(spark, sf_dir), _areas(spark, sf_dir))
    return met.groupBy("area").agg(F.count("*").alias("n"), F.count("kw").alias("rated"), half_up(F.sum("kw") / 1000, 1).alias("mw"))


AOI_SQL = f"SELECT area, count(*) AS n, count(kw) AS rated, floor(sum(kw) / 1000.0::DOUBLE * 10 + 0.5) / 10 AS mw FROM ({TURBINES}) JOIN ({AREAS}) ON {IN_AREA} GROUP BY area"


def point_exclusion_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct layers whose areas hold each site, from two tables of areas."""
    areas = _areas(spark, sf_dir)
    layers = areas.select("ring", "x", "y", "r", F.concat(F.lit("layer"), F.pmod("area", F.lit(4))).alias("layer"), F.when(F.col("area") % 2 == 0, "red").otherwise("amber").alias("class"))
    coarse = areas.where(F.col("area") % 5 == 0).select("ring", "x", "y", "r", F.lit("layer0").alias("layer"), F.when(F.col("area") % 2 == 0, "red").otherwise("amber").alias("class"))
    points = _sites(spark, sf_dir).select("site", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    return in_areas(points, layers.unionByName(coarse)).select("site", "layer", "class").distinct()


HITS_SQL = f"""
WITH a AS ({AREAS}), l AS (SELECT *, 'layer' || (area % 4) AS layer FROM a UNION ALL SELECT *, 'layer0' FROM a WHERE area % 5 = 0)
SELECT DISTINCT site, layer, CASE WHEN area % 2 = 0 THEN 'red' ELSE 'amber' END AS class FROM ({SITES}) JOIN l ON abs(lon - x) + abs(lat - y) < r
"""


def exclusion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each zone's pixels under each class of area, overlaps counted once."""
    pixels = _turbines(spark, sf_dir).select(F.col("turbine").alias("pixel"), F.col("p_brand").alias("zone"), "plon", "plat")
    met = in_areas(pixels, _areas(spark, sf_dir)).withColumn("class", F.when(F.col("area") % 2 == 0, "red").otherwise("amber"))
    hit = met.groupBy("zone", "class").agg(F.countDistinct("pixel").alias("pixels"), F.countDistinct("area").alias("areas"))
    return hit.join(pixels.groupBy("zone").agg(F.count("*").alias("all")), "zone").select("zone", "class", "pixels", "areas", half_up(F.col("pixels") / F.col("all"), 4).alias("share"))


COVER_SQL = f"""
WITH p AS ({TURBINES}), t AS (SELECT p_brand AS zone, count(*) AS n FROM p GROUP BY 1)
SELECT zone, class, pixels, areas, floor(pixels / n * 10000 + 0.5) / 10000 AS share FROM (
  SELECT p_brand AS zone, CASE WHEN area % 2 = 0 THEN 'red' ELSE 'amber' END AS class, count(DISTINCT turbine) AS pixels, count(DISTINCT area) AS areas FROM p JOIN ({AREAS}) ON {IN_AREA} GROUP BY 1, 2) JOIN t USING (zone)
"""


def tile_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mast per cell of 8 pixels at zoom 6, the one with the least id, and its tile."""
    x, y = tile_x(F.col("plon"), 6), tile_y(F.col("plat"), 6)
    rows = _masts(spark, sf_dir).select("mast", F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"), F.floor(x * 32).cast("int").alias("gx"), F.floor(y * 32).cast("int").alias("gy"))
    return rows.groupBy("x", "y", "gx", "gy").agg(F.min("mast").alias("mast"), F.count("*").alias("masts"))


TILE_Y = "(1 - ln(tan(radians(plat)) + 1 / cos(radians(plat))) / pi()) / 2 * 64"
TILE_X = "(plon + 180) / 360 * 64"
THIN_SQL = f"""
SELECT CAST(floor({TILE_X}) AS INT) AS x, CAST(floor({TILE_Y}) AS INT) AS y, CAST(floor({TILE_X} * 32) AS INT) AS gx, CAST(floor({TILE_Y} * 32) AS INT) AS gy, min(mast) AS mast, count(*) AS masts
FROM ({MASTS}) GROUP BY 1, 2, 3, 4
"""


def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles at zoom 8 that each area's bounding box touches."""
    ring = F.col("ring")
    bounds = _areas(spark, sf_dir).select("area", *[f(F.transform(ring, lambda p: p[c])).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("0", F.array_min), ("1", F.array_max))])
    row = lambda lat: F.floor(tile_y(F.least(F.lit(85.0), F.col(lat)), 8)).cast("int")
    column = lambda lon: F.floor(tile_x(F.col(lon), 8)).cast("int")
    return bounds.withColumn("tx", F.explode(F.sequence(column("x0"), column("x1")))).withColumn("ty", F.explode(F.sequence(row("y1"), row("y0")))).select("area", "tx", "ty")


def _ty(lat: str) -> str:
    return f"CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 256) AS INT)"


COVER_TILES_SQL = f"""
SELECT area, CAST(tx AS INT) AS tx, CAST(unnest(range({_ty('y + r')}, {_ty('y - r')} + 1)) AS INT) AS ty FROM (
  SELECT *, unnest(range(CAST(floor((x - r + 180) / 360 * 256) AS INT), CAST(floor((x + r + 180) / 360 * 256) AS INT) + 1)) AS tx FROM ({AREAS}))
"""

WIDTH = 64


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts laid out as a raster of 64 columns; some pixels have no value."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / WIDTH).cast("int").alias("row"), F.pmod(k, F.lit(WIDTH)).cast("int").alias("col"), F.when(k % 29 != 0, F.pmod(k * k, F.lit(301)).cast("double") * 10).alias("z"))


RASTER = "SELECT CAST(p_partkey // 64 AS INT) AS row, CAST(p_partkey % 64 AS INT) AS col, CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey * p_partkey % 301)::DOUBLE * 10 END AS z FROM part"


def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope by central differences where all four neighbours have values; mean, 90th percentile, and share over 15 degrees, by blocks of rows.

    Every pixel sends its value to its four neighbours and itself, and one
    aggregation by pixel brings the five together: the keys are the pixels, so
    no row or column of the raster is ever one task.
    """
    to = lambda r, c, name: F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(name).alias("side"), F.col("z").alias("z"))
    sent = _raster(spark, sf_dir).where("z IS NOT NULL").select(F.explode(F.array(to(0, 0, "own"), to(0, 1, "west"), to(0, -1, "east"), to(1, 0, "north"), to(-1, 0, "south"))).alias("p")).select("p.*")
    rows = sent.groupBy("row", "col").agg(*[F.max(F.when(F.col("side") == n, F.col("z"))).alias(n) for n in ("own", "west", "east", "north", "south")])
    metres = F.lit(30.0) + F.col("row") % 7
    dx, dy = (F.col("east") - F.col("west")) / (2 * metres), (F.col("south") - F.col("north")) / (2 * metres)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    held = rows.withColumn("slope", slope).where(F.col("slope").isNotNull() & F.col("own").isNotNull())
    blocks = held.withColumn("block", F.floor(F.col("row") / 4).cast("int"))
    p90 = quantiles(blocks, "slope", [0.9], "block").select("block", half_up(F.col("slope"), 4).alias("p90"))
    sums = blocks.groupBy("block").agg(F.count("*").alias("pixels"), half_up(F.avg("slope"), 4).alias("mean"), half_up(F.avg((F.col("slope") > 15).cast("double")), 4).alias("steep"))
    return sums.join(p90, "block").select("block", "pixels", "mean", "p90", "steep")


SLOPE_SQL = f"""
WITH z AS ({RASTER}), n AS (
  SELECT c.row, degrees(atan(sqrt(pow((e.z - w.z) / (2 * (30.0::DOUBLE + c.row % 7)), 2) + pow((s.z - n.z) / (2 * (30.0::DOUBLE + c.row % 7)), 2)))) AS slope
  FROM z c JOIN z e ON e.row = c.row AND e.col = c.col + 1 JOIN z w ON w.row = c.row AND w.col = c.col - 1 JOIN z s ON s.col = c.col AND s.row = c.row + 1 JOIN z n ON n.col = c.col AND n.row = c.row - 1
  WHERE c.z IS NOT NULL AND e.z IS NOT NULL AND w.z IS NOT NULL AND s.z IS NOT NULL AND n.z IS NOT NULL
)
SELECT CAST(row // 4 AS INT) AS block, count(*) AS pixels, floor(avg(slope) * 10000 + 0.5) / 10000 AS mean, floor(quantile_cont(slope, 0.9) * 10000 + 0.5) / 10000 AS p90,
  floor(avg(CASE WHEN slope > 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 10000 + 0.5) / 10000 AS steep FROM n GROUP BY 1
"""


def bilinear_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value at each site from the four pixels around it, weights made up for missing ones; null if the nearest is missing."""
    k = F.col("s_suppkey")
    at = table(spark, sf_dir, "supplier").select(k.alias("site"), (F.pmod(k * 7, F.lit(1900)) / F.lit(100.0)).alias("fr"), (F.pmod(k * 13, F.lit(6200)) / F.lit(100.0)).alias("fc"))
    at = at.withColumns({"r0": F.floor("fr").cast("int"), "c0": F.floor("fc").cast("int")}).withColumns({"u": F.col("fr") - F.col("r0"), "v": F.col("fc") - F.col("c0")})
    corner = lambda i, j: F.struct((F.col("r0") + i).alias("row"), (F.col("c0") + j).alias("col"), ((F.col("u") if i else 1 - F.col("u")) * (F.col("v") if j else 1 - F.col("v"))).alias("w"), (((F.col("u") >= 0.5) == F.lit(bool(i))) & ((F.col("v") >= 0.5) == F.lit(bool(j)))).alias("near"))
    spread = at.select("site", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("p")).select("site", "p.*")
    met = spread.join(_raster(spark, sf_dir), ["row", "col"], "left").groupBy("site").agg(F.sum(F.when(F.col("z").isNotNull(), F.col("w") * F.col("z"))).alias("sum"), F.sum(F.when(F.col("z").isNotNull(), F.col("w"))).alias("weight"), F.bool_or(F.col("near") & F.col("z").isNotNull()).alias("known"))
    return met.select("site", half_up(F.when(F.col("known") & (F.col("weight") > 0), F.col("sum") / F.col("weight")), 4).alias("value"))


BILINEAR_SQL = f"""
WITH a AS (SELECT s_suppkey AS site, (s_suppkey * 7 % 1900) / 100.0::DOUBLE AS fr, (s_suppkey * 13 % 6200) / 100.0::DOUBLE AS fc FROM supplier),
b AS (SELECT site, CAST(floor(fr) AS INT) AS r0, CAST(floor(fc) AS INT) AS c0, fr - floor(fr) AS u, fc - floor(fc) AS v FROM a),
p AS (SELECT site, r0 + i AS row, c0 + j AS col, (CASE WHEN i = 1 THEN u ELSE 1 - u END) * (CASE WHEN j = 1 THEN v ELSE 1 - v END) AS w, (u >= 0.5) = (i = 1) AND (v >= 0.5) = (j = 1) AS near FROM b, range(2) AS x(i), range(2) AS y(j)),
m AS (SELECT site, sum(w * z) AS s, sum(CASE WHEN z IS NOT NULL THEN w END) AS w, bool_or(near AND z IS NOT NULL) AS known FROM p LEFT JOIN ({RASTER}) USING (row, col) GROUP BY site)
SELECT site, floor(CASE WHEN known AND w > 0 THEN s / w END * 10000 + 0.5) / 10000 AS value FROM m
"""

QUERIES = {f.__name__: f for f in (masts_within_radius, nearest_mast, nearest_line_segment, ring_search, mast_validation, turbines_in_aoi, point_exclusion_hits, exclusion_coverage, tile_thinning, tile_cover, terrain_slope, bilinear_lookup)}
SQL = {"masts_within_radius": WITHIN_SQL, "nearest_mast": NEAREST_SQL, "nearest_line_segment": LINE_SQL, "ring_search": RING_SQL, "mast_validation": VALIDATION_SQL, "turbines_in_aoi": AOI_SQL, "point_exclusion_hits": HITS_SQL, "exclusion_coverage": COVER_SQL, "tile_thinning": THIN_SQL, "tile_cover": COVER_TILES_SQL, "terrain_slope": SLOPE_SQL, "bilinear_lookup": BILINEAR_SQL}
