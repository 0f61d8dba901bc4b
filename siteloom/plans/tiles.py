"""Lines as vector tiles in an archive, and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.geo import sql_lat, sql_lon, synthetic_lat, synthetic_lon
from siteloom.operators.staging import shared_dir
from siteloom.plans.tables import table
from siteloom.sources.tilearchive import read_tiles, write_archive
from siteloom.sources.vectortiles import EXTENT, decode_tiles, encode_tiles

ZOOM = 6
LAYERS = ("power_line", "power_minor", "railway")
ASKED = ("power_line", "power_minor")


def tile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a map, written as vector tiles into an archive; of every second tile column the power layers are read again: features, the sums of their ends on the tile's grid, and the highest voltage."""
    k = F.col("o_orderkey")
    x, y = synthetic_lon(k * 3), synthetic_lat(k * 7)
    end = F.struct((x + (F.pmod(k * 13, F.lit(400)) - 200) / 100.0).alias("x"), (y + (F.pmod(k * 29, F.lit(300)) - 150) / 100.0).alias("y"))
    layer = F.element_at(F.array(*[F.lit(n) for n in LAYERS]), (F.pmod(k, F.lit(len(LAYERS))) + 1).cast("int"))
    lines = table(spark, sf_dir, "orders").select(k.alias("id"), layer.alias("layer"), F.create_map(F.lit("voltage"), (F.pmod(k * 11, F.lit(8)) * 110).cast("long")).alias("attrs"), F.array(F.struct(x.alias("x"), y.alias("y")), end).alias("points"))
    path = f"{shared_dir(spark)}/siteloom/tiles-{uuid.uuid4().hex}"
    write_archive(encode_tiles(lines, ZOOM), path)
    side = 2**ZOOM
    asked = spark.range(side * side).select(F.lit(ZOOM).alias("z"), F.floor(F.col("id") / side).alias("x"), F.pmod("id", F.lit(side)).alias("y")).where(F.col("x") % 2 == 0)
    found = decode_tiles(read_tiles(spark, path, asked), list(ASKED)).select("x", "y", "layer", "id", F.col("attrs")["voltage"].alias("voltage"), F.explode("lines").alias("line"))
    ends = lambda axis: F.sum(F.aggregate("line", F.lit(0).cast("long"), lambda s, p: s + p[axis]))
    return found.groupBy("x", "y", "layer").agg(F.countDistinct("id").alias("features"), ends("x").alias("xs"), ends("y").alias("ys"), F.max("voltage").alias("voltage"))


def _tile_y(lat: str) -> str:
    return f"((1.0::DOUBLE - ln(tan(radians({lat})) + 1.0::DOUBLE / cos(radians({lat}))) / pi()) / 2.0::DOUBLE * {2**ZOOM}.0::DOUBLE)"


def _reach(p: str, d: str) -> tuple[str, str]:
    """From where to where along a line a coordinate lies inside the tile."""
    a, b = f"(-{p} / {d})", f"(({EXTENT}.0::DOUBLE - {p}) / {d})"
    inside = f"({p} >= 0 AND {p} <= {EXTENT})"
    return f"CASE WHEN {d} <> 0 THEN least({a}, {b}) WHEN {inside} THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END", f"CASE WHEN {d} <> 0 THEN greatest({a}, {b}) WHEN {inside} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


_XR, _YR = _reach("px", "dx"), _reach("py", "dy")
TILE_SQL = f"""
WITH o AS (SELECT o_orderkey AS k, {sql_lon('o_orderkey * 3')} AS x0, {sql_lat('o_orderkey * 7')} AS y0 FROM orders),
e AS (SELECT k, x0, y0, x0 + (k * 13 % 400 - 200) / 100.0::DOUBLE AS x1, y0 + (k * 29 % 300 - 150) / 100.0::DOUBLE AS y1 FROM o),
m AS (SELECT k, (x0 + 180.0::DOUBLE) / 360.0::DOUBLE * {2**ZOOM}.0::DOUBLE AS ax, {_tile_y('y0')} AS ay, (x1 + 180.0::DOUBLE) / 360.0::DOUBLE * {2**ZOOM}.0::DOUBLE AS bx, {_tile_y('y1')} AS by_ FROM e),
t AS (SELECT k, tx, ty, (ax - tx) * {EXTENT}.0::DOUBLE AS px, (ay - ty) * {EXTENT}.0::DOUBLE AS py, (bx - tx) * {EXTENT}.0::DOUBLE AS qx, (by_ - ty) * {EXTENT}.0::DOUBLE AS qy
  FROM m, unnest(range(CAST(floor(least(ax, bx)) AS BIGINT), CAST(floor(greatest(ax, bx)) AS BIGINT) + 1)) AS u(tx), unnest(range(CAST(floor(least(ay, by_)) AS BIGINT), CAST(floor(greatest(ay, by_)) AS BIGINT) + 1)) AS v(ty)),
d AS (SELECT *, qx - px AS dx, qy - py AS dy FROM t),
r AS (SELECT *, greatest(0.0::DOUBLE, {_XR[0]}, {_YR[0]}) AS lo, least(1.0::DOUBLE, {_XR[1]}, {_YR[1]}) AS hi FROM d),
g AS (SELECT k, tx, ty, CAST(floor(CASE WHEN lo > 0 THEN px + dx * lo ELSE px END + 0.5) AS BIGINT) AS x0, CAST(floor(CASE WHEN lo > 0 THEN py + dy * lo ELSE py END + 0.5) AS BIGINT) AS y0,
  CAST(floor(CASE WHEN hi < 1 THEN px + dx * hi ELSE qx END + 0.5) AS BIGINT) AS x1, CAST(floor(CASE WHEN hi < 1 THEN py + dy * hi ELSE qy END + 0.5) AS BIGINT) AS y1 FROM r WHERE lo < hi)
SELECT tx AS x, ty AS y, {list(LAYERS)!r}[CAST(k % {len(LAYERS)} + 1 AS INT)] AS layer, count(DISTINCT k) AS features, CAST(sum(x0 + x1) AS BIGINT) AS xs, CAST(sum(y0 + y1) AS BIGINT) AS ys, CAST(max(k * 11 % 8 * 110) AS BIGINT) AS voltage
FROM g WHERE (x0 <> x1 OR y0 <> y1) AND tx % 2 = 0 AND k % {len(LAYERS)} < {len(ASKED)} GROUP BY 1, 2, 3
"""

QUERIES = {"tile_lines": tile_lines}
SQL = {"tile_lines": TILE_SQL}
