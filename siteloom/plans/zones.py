"""Zones as polygons: what they cover together, their repair on load, and their buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM, sql_lat, sql_lon, synthetic_lat, synthetic_lon
from siteloom.functions.numeric import half_up
from siteloom.operators import buffers, repair
from siteloom.operators.coverage import HOLE, WINDOW, ZONE, covered_in_windows, covered_km2, ring_km2
from siteloom.operators.proximity import spread_over
from siteloom.plans.spatial import MASTS, SITES, _masts, _sites
from siteloom.plans.tables import table

CELL = 1.0
FINE_CELL = 0.1  # degrees; a zone fills several
AREA = [(-0.3, -0.3), (0.3, -0.25), (0.1, 0.0), (0.3, 0.3), (-0.25, 0.3)]  # degrees around an area's point; concave
SHAPES = ([(-0.5, -0.4), (0.4, -0.2), (0.1, 0.1), (0.2, 0.6), (-0.2, 0.1)], [(-0.4, -0.5), (0.5, 0.1), (-0.5, 0.2), (0.3, -0.6), (0.1, 0.6)])  # of zones: concave, and crossing itself
REACH = 0.95  # degrees at most between the points of a zone and an area that meet


def shape(x: Column, y: Column, corners: list[tuple[float, float]], scale: float | Column = 1.0) -> Column:
    """An open ring of corners around a point."""
    return F.array(*[F.struct((x + F.lit(a) * scale).alias("x"), (y + F.lit(b) * scale).alias("y")) for a, b in corners])


def exclusion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each area, what each layer's zones of a class cover of it together, and all layers' zones of a class; an overlap counts once."""
    sites, masts = _sites(spark, sf_dir).select("site", "lon", "lat"), _masts(spark, sf_dir)
    kind = F.when(F.col("mast") % 2 == 0, "red").otherwise("amber").alias("class")
    layers = F.array(*[F.struct(layer.alias("layer"), kind) for layer in (F.concat(F.lit("layer"), F.pmod("mast", F.lit(3))), F.lit("all"))])
    ring = F.when(F.col("mast") % 5 < 3, shape(F.col("plon"), F.col("plat"), SHAPES[0])).otherwise(shape(F.col("plon"), F.col("plat"), SHAPES[1]))
    windows = sites.select("site", shape(F.col("lon"), F.col("lat"), AREA).alias("ring"))
    found = covered_in_windows(masts.select(layers.alias("groups"), ring.alias("ring")), windows, "site", "groups", FINE_CELL, spread_over(sites))
    areas = sites.select("site", ring_km2(shape(F.col("lon"), F.col("lat"), AREA)).alias("all"))
    return found.join(areas, "site").select("site", "layer", "class", half_up(F.col("km2"), 3).alias("km2"), half_up(F.col("km2") / F.col("all"), 4).alias("share")).where("km2 > 0")


def sql_edges(key: str, role: str, polygon: str, points: str, source: str) -> str:
    """Edges of the open rings ``points``, an SQL list of {x, y}."""
    return f"SELECT k, role, polygon, p[i].x AS ux, p[i].y AS uy, p[i % len(p) + 1].x AS vx, p[i % len(p) + 1].y AS vy FROM (SELECT {key} AS k, {role} AS role, {polygon} AS polygon, {points} AS p FROM {source}), unnest(generate_series(1, len(p))) AS u(i)"


def sql_shape(x: str, y: str, corners: list[tuple[float, float]]) -> str:
    return "[" + ", ".join(f"{{'x': {x} + {a}::DOUBLE, 'y': {y} + {b}::DOUBLE}}" for a, b in corners) + "]"


def sql_under(a: str, b: str) -> str:
    """The mean of sin over a straight piece between two latitudes."""
    return f"(sin(radians(({a} + {b}) / 2)) * CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE sin(radians(({b} - {a}) / 2)) / radians(({b} - {a}) / 2) END)"


def sql_sweep(edges: str, within: bool) -> str:
    """CTEs that end in ``covered`` (k, km2): the area in a zone, in no hole and, if ``within``, in a window."""
    depth = lambda role: f"sum(CASE WHEN role = '{role}' THEN sign ELSE 0 END) OVER (PARTITION BY k, lo ORDER BY a + b, polygon, role ROWS UNBOUNDED PRECEDING)"
    inside = "zone_depth > 0 AND hole_depth = 0" + (" AND window_depth > 0" if within else "")
    return f"""
edges AS ({edges}),
e AS (SELECT k, role, polygon, least(ux, vx) AS x0, greatest(ux, vx) AS x1, CASE WHEN ux < vx THEN uy ELSE vy END AS y0, (vy - uy) / (vx - ux) AS m FROM edges WHERE ux <> vx),
c AS (SELECT k, unnest([x0, x1]) AS x FROM e UNION SELECT a.k, ((b.y0 - b.m * b.x0) - (a.y0 - a.m * a.x0)) / (a.m - b.m) AS x FROM e a JOIN e b ON a.k = b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.m < b.m
  WHERE ((b.y0 - b.m * b.x0) - (a.y0 - a.m * a.x0)) / (a.m - b.m) > greatest(a.x0, b.x0) AND ((b.y0 - b.m * b.x0) - (a.y0 - a.m * a.x0)) / (a.m - b.m) < least(a.x1, b.x1)),
s AS (SELECT k, x AS lo, lead(x) OVER (PARTITION BY k ORDER BY x) AS hi FROM c),
p AS (SELECT s.k, lo, hi, role, polygon, y0 + m * (lo - x0) AS a, y0 + m * (hi - x0) AS b FROM s JOIN e ON e.k = s.k AND e.x0 <= lo AND e.x1 >= hi),
q AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k, lo, role, polygon ORDER BY a + b) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM p),
d AS (SELECT k, lo, hi, a, b, {depth(ZONE)} AS zone_depth, {depth(HOLE)} AS hole_depth, {depth(WINDOW)} AS window_depth, lead(a) OVER (PARTITION BY k, lo ORDER BY a + b, polygon, role) AS a2, lead(b) OVER (PARTITION BY k, lo ORDER BY a + b, polygon, role) AS b2 FROM q),
covered AS (SELECT k, {EARTH_KM}::DOUBLE * {EARTH_KM}::DOUBLE * sum(radians(hi - lo) * ({sql_under('a2', 'b2')} - {sql_under('a', 'b')})) AS km2 FROM d WHERE {inside} GROUP BY k)"""


def sql_ring_km2(points: str) -> str:
    return f"abs(list_sum(list_transform(generate_series(1, len({points})), lambda i: radians({points}[i % len({points}) + 1].x - {points}[i].x) * {sql_under(f'{points}[i].y', f'{points}[i % len({points}) + 1].y')}))) * {EARTH_KM}::DOUBLE * {EARTH_KM}::DOUBLE"


UNION_SQL = f"""
WITH z AS (SELECT mast, plon, plat, 'layer' || (mast % 3) AS layer, CASE WHEN mast % 2 = 0 THEN 'red' ELSE 'amber' END AS class FROM ({MASTS})),
met AS (SELECT {{'site': site, 'layer': l, 'class': class}} AS k, site, lon, lat, mast, plon, plat FROM ({SITES}) JOIN z ON abs(lon - plon) < {REACH} AND abs(lat - plat) < {REACH}, unnest([layer, 'all']) AS u(l)),
{sql_sweep(
    sql_edges('k', "'zone'", 'mast', f"CASE WHEN mast % 5 < 3 THEN {sql_shape('plon', 'plat', SHAPES[0])} ELSE {sql_shape('plon', 'plat', SHAPES[1])} END", 'met') + ' UNION ALL '
    + sql_edges('k', "'window'", '0', sql_shape('lon', 'lat', AREA), '(SELECT DISTINCT k, lon, lat FROM met)'), True)},
a AS (SELECT site, {sql_ring_km2('p')} AS km2 FROM (SELECT site, {sql_shape('lon', 'lat', AREA)} AS p FROM ({SITES})))
SELECT k.site AS site, k.layer AS layer, k.class AS class, floor(covered.km2 * 1000 + 0.5) / 1000 AS km2, floor(covered.km2 / a.km2 * 10000 + 0.5) / 10000 AS share FROM covered JOIN a ON a.site = k.site WHERE floor(covered.km2 * 1000 + 0.5) > 0
"""

#: Rings of features as they come: sound, a bow tie, a five-pointed star drawn in one stroke, a spike, a hole of its own ring, a line and back, and a part that covers another twice.
RAW = {
    "sound": [[(0, 0), (4, 0), (4, 3), (0, 4)]], "bow": [[(0, 0), (4, 4), (4, 0), (0, 4)]], "star": [[(2, 0), (3.2, 3.8), (0, 1.4), (4, 1.5), (0.8, 3.7)]], "spike": [[(0, 0), (4, 0), (4, 2), (6, 2), (4, 2), (4, 4), (0, 4)]],
    "holed": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]], "line": [[(0, 0), (2, 2), (4, 4)]], "twice": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 0), (2, 2), (0, 2)]],
}
PARTS = {"sound": (1, 0), "bow": (2, 0), "star": (5, 0), "spike": (1, 0), "holed": (1, 1), "line": (0, 0), "twice": (1, 0)}


def repaired_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as a load keeps them: valid polygons whose area is what lies in an odd number of their rings; those without an area go."""
    k = F.col("c_custkey")
    x, y, w = synthetic_lon(k * 7), synthetic_lat(k * 5), F.lit(0.01) + F.pmod(k * 17, F.lit(50)) / F.lit(1000.0)
    kinds = list(RAW)
    rings = F.lit(None)
    for i, kind in enumerate(kinds):
        rings = F.when(F.pmod(k, F.lit(len(kinds))) == i, F.array(*[shape(x, y, ring, w) for ring in RAW[kind]])).otherwise(rings)
    rows = table(spark, sf_dir, "customer").select(k.alias("feature"), F.element_at(F.array(*[F.lit(n) for n in kinds]), (F.pmod(k, F.lit(len(kinds))) + 1).cast("int")).alias("kind"), rings.alias("rings"))
    km2 = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + ring_km2(p[0]) - F.aggregate(F.slice(p, 2, 1 << 20), F.lit(0.0), lambda t, h: t + ring_km2(h)))
    holes = F.aggregate("polygons", F.lit(0), lambda s, p: s + F.size(p) - 1)
    return repair.valid_rows(rows, "rings").select("feature", "kind", F.size("polygons").alias("parts"), holes.alias("holes"), half_up(km2, 3).alias("km2"))


def _raw_edges() -> str:
    out = []
    for i, (kind, rings) in enumerate(RAW.items()):
        for ring in rings:
            points = "[" + ", ".join(f"{{'x': x + {a}::DOUBLE * w, 'y': y + {b}::DOUBLE * w}}" for a, b in ring) + "]"
            out.append(sql_edges("feature", "'zone'", "1", points, f"(SELECT * FROM f WHERE feature % {len(RAW)} = {i})"))
    return " UNION ALL ".join(out)


REPAIR_SQL = f"""
WITH f AS (SELECT c_custkey AS feature, {sql_lon('c_custkey * 7')} AS x, {sql_lat('c_custkey * 5')} AS y, 0.01::DOUBLE + (c_custkey * 17 % 50) / 1000.0::DOUBLE AS w FROM customer),
{sql_sweep(_raw_edges(), False)}
SELECT k AS feature, {list(RAW)!r}[CAST(k % {len(RAW)} + 1 AS INT)] AS kind, {[p for p, _ in PARTS.values()]!r}[CAST(k % {len(RAW)} + 1 AS INT)] AS parts, {[h for _, h in PARTS.values()]!r}[CAST(k % {len(RAW)} + 1 AS INT)] AS holes, floor(km2 * 1000 + 0.5) / 1000 AS km2
FROM covered WHERE km2 > 1e-6
"""

# Rules of buffers around a point (km), and of the zone around a core that has none of its own.
CIRCLES = [("prohibited_100m", "red", 0.1), ("regulated_300m", "amber", 0.3), ("institution_500m", "amber", 0.5)]
ZONE_KM, HULL_KM = 10.0, 0.5
CORE = [(-0.05, -0.04), (0.06, -0.05), (0.0, 0.01), (0.05, 0.06)]  # concave
HULL = [(-0.01, -0.01), (0.012, -0.008), (0.015, 0.006), (0.0, 0.013)]  # convex, counter-clockwise


def buffer_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers as polygons and their areas: circles around monuments, 10 km around cores without the core, 500 m around the hulls of settlements."""
    k = F.col("s_suppkey")
    marks = table(spark, sf_dir, "supplier")
    rows = marks.repartition(spread_over(marks)).select(k.alias("mark"), synthetic_lon(k * 13).alias("x"), synthetic_lat(k * 19).alias("y"))
    at = F.struct("x", "y")
    rings = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("class"), buffers.circle(at, F.lit(km)).alias("ring")) for rule, kind, km in CIRCLES], F.struct(F.lit("settlement_500m").alias("rule"), F.lit("red").alias("class"), buffers.convex_buffer(shape(F.col("x"), F.col("y"), HULL), F.lit(HULL_KM)).alias("ring"))))
    simple = rows.select("mark", rings.alias("r")).select("mark", "r.rule", "r.class", ring_km2(F.col("r.ring")).alias("km2"))
    cores = rows.select("mark", shape(F.col("x"), F.col("y"), CORE).alias("core"))
    part = lambda d, role, ring: d.select("mark", F.xxhash64(ring).alias("polygon"), F.lit(role).alias("role"), F.col(ring).alias("ring"))
    around_cores = part(buffers.buffer_parts(cores, "core", F.lit(ZONE_KM)), ZONE, "part").unionByName(part(cores, HOLE, "core"))
    zone = covered_km2(around_cores, ["mark"], CELL).select("mark", F.lit("esz_10km").alias("rule"), F.lit("amber").alias("class"), "km2")
    return simple.unionByName(zone).select("mark", "rule", "class", half_up(F.col("km2"), 4).alias("km2"))


def sql_destination(p: str, bearing: str, km: float | str) -> str:
    """{x, y} at a distance and direction from a point, in SQL."""
    d, lat, b = f"({km}::DOUBLE / {EARTH_KM}::DOUBLE)", f"radians({p}.y)", f"radians({bearing})"
    there = f"asin(sin({lat}) * cos({d}) + cos({lat}) * sin({d}) * cos({b}))"
    return f"{{'x': degrees(radians({p}.x) + atan2(sin({b}) * sin({d}) * cos({lat}), cos({d}) - sin({lat}) * sin({there}))), 'y': degrees({there})}}"


def sql_bearing(p: str, q: str) -> str:
    a, b, d = f"radians({p}.y)", f"radians({q}.y)", f"radians({q}.x - {p}.x)"
    return f"degrees(atan2(sin({d}) * cos({b}), cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d})))"


def _sql_capsule(p: str, q: str, km: float) -> str:
    n = buffers.STEPS // 2
    one = lambda a, b: f"list_transform(generate_series(0, {n}), lambda i: {sql_destination(b, f'({sql_bearing(a, b)} + 90 - 180.0::DOUBLE * i / {n})', km)})"
    return f"list_concat({one(p, q)}, {one(q, p)})"


def _sql_hull_buffer() -> str:
    n, arcs = len(HULL), []
    for i in range(n):
        p, before, after = (f"h[{j % n + 1}]" for j in (i, i - 1, i + 1))
        start, end = f"({sql_bearing(p, before)} - 90)", f"({sql_bearing(p, after)} + 90)"
        turn = f"((({start} - {end}) % 360 + 360) % 360)"
        arcs.append(f"list_transform(generate_series(0, CAST(greatest(1, ceil({turn} * {buffers.STEPS} / 360)) AS BIGINT)), lambda i: {sql_destination(p, f'({start} - {turn} * i / greatest(1, ceil({turn} * {buffers.STEPS} / 360)))', HULL_KM)})")
    return f"flatten([{', '.join(arcs)}])"


BUFFER_SQL = f"""
WITH m AS (SELECT s_suppkey AS mark, {sql_lon('s_suppkey * 13')} AS x, {sql_lat('s_suppkey * 19')} AS y FROM supplier),
g AS (SELECT mark, {{'x': x, 'y': y}} AS p, {sql_shape('x', 'y', CORE)} AS core, {sql_shape('x', 'y', HULL)} AS h FROM m),
r AS ({' UNION ALL '.join(f"SELECT mark, '{rule}' AS rule, '{kind}' AS class, list_transform(generate_series(0, {buffers.STEPS - 1}), lambda i: {sql_destination('p', f'(90.0::DOUBLE - i * (360.0::DOUBLE / {buffers.STEPS}))', km)}) AS ring FROM g" for rule, kind, km in CIRCLES)}
  UNION ALL SELECT mark, 'settlement_500m', 'red', {_sql_hull_buffer()} FROM g),
simple AS (SELECT mark, rule, class, {sql_ring_km2('ring')} AS km2 FROM r),
caps AS (SELECT mark, i, {_sql_capsule('core[i]', f'core[i % {len(CORE)} + 1]', ZONE_KM).replace('lambda i:', 'lambda j:').replace('* i /', '* j /')} AS ring FROM g, unnest(generate_series(1, {len(CORE)})) AS u(i)),
{sql_sweep(sql_edges('mark', "'zone'", 'i', 'ring', 'caps') + ' UNION ALL ' + sql_edges('mark', "'zone'", '99', 'core', 'g') + ' UNION ALL ' + sql_edges('mark', "'hole'", '1', 'core', 'g'), False)}
SELECT mark, rule, class, floor(km2 * 10000 + 0.5) / 10000 AS km2 FROM (SELECT * FROM simple UNION ALL SELECT k, 'esz_10km', 'amber', km2 FROM covered)
"""

QUERIES = {f.__name__: f for f in (exclusion_union, repaired_zones, buffer_zones)}
SQL = {"exclusion_union": UNION_SQL, "repaired_zones": REPAIR_SQL, "buffer_zones": BUFFER_SQL}
