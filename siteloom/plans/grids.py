"""Rasters in tiles: zones from map colours, feathered edges, reprojection, windows of a stored raster."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.numeric import half_up
from siteloom.operators import rasters, shapes
from siteloom.operators.staging import shared_dir
from siteloom.plans.spatial import RASTER, SITES, _raster, _sites
from siteloom.plans.tables import table
from siteloom.sources.rasters import read_windows, write_raster

SIDE, WIDTH, RADIUS, FADE = 16, 64, 1, 3.0
CLASSES = ("red", "amber", "green")  # a pixel goes to the first that has it


def _height(pixels: DataFrame) -> int:
    return int((pixels.agg(F.max("row")).first()[0] or 0) + 1)


def _coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels of a map: most in the colour of their surroundings, some in none."""
    k = F.col("p_partkey")
    row, col = F.floor(k / WIDTH).cast("int"), F.pmod(k, F.lit(WIDTH)).cast("int")
    block = F.pmod(F.floor(row / 5) * 7 + F.floor(col / 5) * 3, F.lit(4))
    noise = F.pmod(k * 37 + F.pmod(k * k, F.lit(101)), F.lit(5))
    shade = F.when(noise == 0, 3).otherwise(block)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (shade + 1).cast("int"))
    return table(spark, sf_dir, "part").select(row.alias("row"), col.alias("col"), shapes.zone_class(pick([200, 220, 60, 255]), pick([60, 220, 180, 255]), pick([60, 60, 60, 255])).alias("class"))


def zone_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map pixels of each zone class made solid: their mask is closed, its holes are filled, and stricter classes claim pixels first. By class and tile."""
    pixels = _coloured(spark, sf_dir)
    height = _height(pixels)
    solid = []
    for name in CLASSES:
        mask = rasters.tiles_of(pixels.where(F.col("class") == name).withColumn("value", F.lit(1.0)), SIDE, "uint8", 0)
        solid.append(rasters.filled(rasters.closed(mask, RADIUS, SIDE, height, WIDTH), SIDE, height, WIDTH))
    found = rasters.pixels_of(rasters.claimed(solid, SIDE), SIDE, "uint8", height, WIDTH, "long").where("value > 0")
    ty, tx = F.floor(F.col("row") / SIDE).cast("int"), F.floor(F.col("col") / SIDE).cast("int")
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("value").cast("int"))
    return found.groupBy(name.alias("class"), ty.alias("ty"), tx.alias("tx")).agg(F.count("*").alias("pixels"), F.sum(F.col("row") * WIDTH + F.col("col")).alias("places"))


_DISK = "(VALUES " + ", ".join(f"({i}, {j})" for i, j in rasters.disk(RADIUS)) + ") AS o(i, j)"
_SHADE = "CASE WHEN (k * 37 + k * k % 101) % 5 = 0 THEN 3 ELSE (row // 5 * 7 + col // 5 * 3) % 4 END"
MOSAIC_SQL = f"""
WITH RECURSIVE px AS (SELECT row, col, {_SHADE} AS shade FROM (SELECT p_partkey AS k, p_partkey // {WIDTH} AS row, p_partkey % {WIDTH} AS col FROM part)),
size AS (SELECT max(row) + 1 AS height FROM px), m AS (SELECT row, col, shade AS class FROM px WHERE shade < 3),
every AS (SELECT row, col, class FROM (SELECT unnest(range(height)) AS row FROM size), (SELECT unnest(range({WIDTH})) AS col), (SELECT unnest([0, 1, 2]) AS class)),
wide AS (SELECT DISTINCT class, row + i AS row, col + j AS col FROM m, {_DISK}), inner_ AS (SELECT w.* FROM wide w, size WHERE row >= 0 AND row < height AND col >= 0 AND col < {WIDTH}),
eroded AS (SELECT class, row, col FROM (SELECT class, row + i AS row, col + j AS col FROM inner_, {_DISK}) GROUP BY 1, 2, 3 HAVING count(*) = {len(rasters.disk(RADIUS))}),
shut AS (SELECT e.* FROM every e JOIN eroded USING (class, row, col)), free AS (SELECT e.* FROM every e ANTI JOIN shut USING (class, row, col)),
open_ AS (SELECT class, row, col FROM free, size WHERE row IN (0, height - 1) OR col IN (0, {WIDTH - 1})
  UNION SELECT f.class, f.row, f.col FROM open_ a JOIN free f ON f.class = a.class AND abs(f.row - a.row) + abs(f.col - a.col) = 1),
solid AS (SELECT e.* FROM every e ANTI JOIN open_ USING (class, row, col)), best AS (SELECT row, col, min(class) AS class FROM solid GROUP BY 1, 2)
SELECT {list(CLASSES)!r}[CAST(class + 1 AS INT)] AS class, CAST(row // {SIDE} AS INT) AS ty, CAST(col // {SIDE} AS INT) AS tx, count(*) AS pixels, CAST(sum(row * {WIDTH} + col) AS BIGINT) AS places FROM best GROUP BY 1, 2, 3
"""


def distance_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far inside a covered area each of its pixels lies, and the opacity that fades over the outermost ones."""
    k = F.col("row") * WIDTH + F.col("col")
    pixels = _raster(spark, sf_dir).select("row", "col", (F.pmod(k * 7 + F.col("row"), F.lit(23)) > 0).cast("double").alias("value"))
    height = _height(pixels)
    mask = rasters.tiles_of(pixels, SIDE, "uint8", 0)
    found = rasters.pixels_of(rasters.squared_distances(mask, SIDE, height, WIDTH), SIDE, "float64", height, WIDTH).where("value > 0")
    return found.select("row", "col", F.col("value").alias("squared"), half_up(F.least(F.lit(1.0), F.sqrt("value") / FADE), 6).alias("alpha"))


FEATHER_SQL = f"""
WITH c AS (SELECT row, col, ((row * {WIDTH} + col) * 7 + row) % 23 > 0 AS land FROM ({RASTER})),
every AS (SELECT row, col FROM (SELECT unnest(range((SELECT max(row) + 1 FROM c))) AS row), (SELECT unnest(range({WIDTH})) AS col)),
sea AS (SELECT e.row, e.col FROM every e LEFT JOIN c ON c.row = e.row AND c.col = e.col WHERE c.land IS NOT TRUE),
d AS (SELECT c.row, c.col, min((c.row - s.row) * (c.row - s.row) + (c.col - s.col) * (c.col - s.col)) AS squared FROM c, sea s WHERE c.land GROUP BY 1, 2)
SELECT row, col, squared::DOUBLE AS squared, floor(least(1.0::DOUBLE, sqrt(squared::DOUBLE) / {FADE}::DOUBLE) * 1e6 + 0.5) / 1e6 AS alpha FROM d
"""

ZOOM, TILE_SIDE, TX0, TY0, ACROSS = 5, 16, 21, 12, 4  # a mosaic of four by four tiles over the map
LAT0, LAT1, LON0, LON1, STEP, TENTHS = 6.0, 38.0, 67.0, 98.0, 0.1, 10
SIDE_PX = ACROSS * TILE_SIDE


def mercator(lon: Column, lat: Column, zoom: int, side: int) -> tuple[Column, Column]:
    """Column and row of a point in pixels of the whole map at a zoom, as fractions."""
    r = F.radians(lat)
    scale = float(2**zoom * side)
    return (lon + 180.0) / 360.0 * scale, (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * scale


def reproject(tiles: DataFrame, nodes: DataFrame, zoom: int, side: int) -> DataFrame:
    """``nodes`` (lon, lat and more) with ``value``: bilinear between the four pixels of the mosaic around each, over tile borders; null without one.

    ``tiles`` are pixels (tx, ty, px, py, value) with ``turn``; where several
    tiles lie on each other the one with the highest turn counts. Pixels without
    a value (null or NaN) have no weight, and the others share it.
    """
    x, y = mercator(F.col("lon"), F.col("lat"), zoom, side)
    last = tiles.groupBy("tx", "ty", "px", "py").agg(F.max_by("value", "turn").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    at = nodes.withColumns({"gx": x - 0.5, "gy": y - 0.5})  # pixels stand at their centres
    corners = F.explode(F.array(*[F.struct((F.floor("gx") + i).alias("x"), (F.floor("gy") + j).alias("y")) for i in (0, 1) for j in (0, 1)])).alias("corner")
    sent = at.select(*nodes.columns, "gx", "gy", corners).withColumn("w", (1.0 - F.abs(F.col("gx") - F.col("corner.x"))) * (1.0 - F.abs(F.col("gy") - F.col("corner.y")))).where("w > 0")
    keyed = sent.select(*nodes.columns, "w", F.floor(F.col("corner.x") / side).alias("tx"), F.floor(F.col("corner.y") / side).alias("ty"), F.pmod("corner.x", F.lit(side)).alias("px"), F.pmod("corner.y", F.lit(side)).alias("py"))
    met = keyed.join(last, ["tx", "ty", "px", "py"])
    return met.groupBy(*nodes.columns).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))


def mosaic_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic of map tiles as values at the nodes of a grid of tenths of a degree, in whole tenths; nodes that only pixels without a value surround are left out, as are values that are not positive."""
    k = F.col("p_partkey")
    at = F.pmod(k * 11, F.lit(SIDE_PX * SIDE_PX))
    row, col = F.floor(at / SIDE_PX), F.pmod(at, F.lit(SIDE_PX))
    tiles = table(spark, sf_dir, "part").select((F.floor(col / TILE_SIDE) + TX0).alias("tx"), (F.floor(row / TILE_SIDE) + TY0).alias("ty"), F.pmod(col, F.lit(TILE_SIDE)).alias("px"), F.pmod(row, F.lit(TILE_SIDE)).alias("py"), F.when(k % 29 != 0, F.pmod(k * k, F.lit(301)).cast("double") / 10).alias("value"), k.alias("turn"))
    down, across = round((LAT1 - LAT0) / STEP) + 1, round((LON1 - LON0) / STEP) + 1
    r, c = F.floor(F.col("id") / across), F.pmod("id", F.lit(across))
    nodes = spark.range(down * across).select(r.alias("r"), c.alias("c"), (LON0 + c / 10.0).alias("lon"), (LAT0 + r / 10.0).alias("lat"))
    found = reproject(tiles, nodes, ZOOM, TILE_SIDE)
    return found.select("r", "c", F.floor(half_up(F.col("value"), 6) * TENTHS + 0.5).cast("long").alias("tenths"), half_up(F.col("value"), 6).alias("value")).where("value > 0")


_X = f"((67.0::DOUBLE + c / 10.0::DOUBLE) + 180.0::DOUBLE) / 360.0::DOUBLE * {2**ZOOM * TILE_SIDE}.0::DOUBLE - 0.5::DOUBLE"
_LAT = "radians(6.0::DOUBLE + r / 10.0::DOUBLE)"
_Y = f"(1.0::DOUBLE - ln(tan({_LAT}) + 1.0::DOUBLE / cos({_LAT})) / pi()) / 2.0::DOUBLE * {2**ZOOM * TILE_SIDE}.0::DOUBLE - 0.5::DOUBLE"
REPROJECT_SQL = f"""
WITH p AS (SELECT p_partkey AS k, p_partkey * 11 % {SIDE_PX * SIDE_PX} AS spot FROM part),
m AS (SELECT spot % {SIDE_PX} + {TX0 * TILE_SIDE} AS x, spot // {SIDE_PX} + {TY0 * TILE_SIDE} AS y, arg_max({{'v': CASE WHEN k % 29 <> 0 THEN (k * k % 301)::DOUBLE / 10 END}}, k).v AS v FROM p GROUP BY spot),
n AS (SELECT r, c, {_X} AS gx, {_Y} AS gy FROM (SELECT unnest(range({round((LAT1 - LAT0) / STEP) + 1})) AS r), (SELECT unnest(range({round((LON1 - LON0) / STEP) + 1})) AS c)),
s AS (SELECT r, c, CAST(floor(gx) AS BIGINT) + i AS x, CAST(floor(gy) AS BIGINT) + j AS y, (1.0::DOUBLE - abs(gx - floor(gx) - i)) * (1.0::DOUBLE - abs(gy - floor(gy) - j)) AS w FROM n, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(i, j)),
g AS (SELECT r, c, sum(w * v) / sum(w) AS value FROM s JOIN m USING (x, y) WHERE v IS NOT NULL AND w > 0 GROUP BY 1, 2)
SELECT r, c, CAST(floor(floor(value * 1e6 + 0.5) / 1e6 * {TENTHS} + 0.5) AS BIGINT) AS tenths, floor(value * 1e6 + 0.5) / 1e6 AS value FROM g WHERE value > 0
"""

HALF = 9  # pixels on each side of a window's middle


def raster_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a raster that is stored in blocks and read again: pixels, those with a value, their mean and extremes. Windows are cut at the raster's edge; blocks that are missing have no values."""
    pixels = _raster(spark, sf_dir).select("row", "col", F.col("z").alias("value"))
    height = _height(pixels)
    tiles = rasters.tiles_of(pixels, SIDE, "float32", math.nan).where((F.col("ty") * 4 + F.col("tx")) % 9 != 4)
    path = f"{shared_dir(spark)}/siteloom/raster-{uuid.uuid4().hex}"
    write_raster(tiles, path, SIDE, height, WIDTH)
    s = F.col("site")
    row, col = F.pmod(s * 31, F.lit(height)), F.pmod(s * 17, F.lit(WIDTH))
    windows = _sites(spark, sf_dir).select("site", (row - HALF).alias("top"), (row + HALF).alias("bottom"), (col - HALF).alias("left"), (col + HALF).alias("right"))
    known = F.when(~F.isnan("value"), F.col("value").cast("double"))
    found = read_windows(spark, path, windows).groupBy("site", "top", "bottom", "left", "right")
    return found.agg(F.count("*").alias("pixels"), F.count(known).alias("known"), half_up(F.avg(known), 4).alias("mean"), F.min(known).alias("low"), F.max(known).alias("high")).select("site", "pixels", "known", "mean", "low", "high")


WINDOW_SQL = f"""
WITH p AS ({RASTER}), size AS (SELECT max(row) + 1 AS height FROM p), every AS (SELECT row, col FROM (SELECT unnest(range(height)) AS row FROM size), (SELECT unnest(range({WIDTH})) AS col)),
v AS (SELECT e.row, e.col, CASE WHEN (e.row // {SIDE} * 4 + e.col // {SIDE}) % 9 <> 4 THEN p.z END AS z FROM every e LEFT JOIN p ON p.row = e.row AND p.col = e.col),
w AS (SELECT site, site * 31 % height AS r, site * 17 % {WIDTH} AS c FROM ({SITES}), size)
SELECT site, count(*) AS pixels, count(z) AS known, floor(avg(z) * 10000 + 0.5) / 10000 AS mean, min(z) AS low, max(z) AS high FROM w JOIN v ON v.row >= r - {HALF} AND v.row < r + {HALF} AND v.col >= c - {HALF} AND v.col < c + {HALF} GROUP BY site
"""

QUERIES = {f.__name__: f for f in (zone_mosaic, distance_feather, mosaic_reprojection, raster_windows)}
SQL = {"zone_mosaic": MOSAIC_SQL, "distance_feather": FEATHER_SQL, "mosaic_reprojection": REPROJECT_SQL, "raster_windows": WINDOW_SQL}
