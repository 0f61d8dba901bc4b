"""Grids, buffers, label points, masks and small numeric models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.geo import EARTH_KM, haversine_km, sql_haversine, sql_lat, sql_lon, synthetic_lat, synthetic_lon
from siteloom.functions.numeric import half_up
from siteloom.operators.proximity import spread_over
from siteloom.operators.shapes import area_km2
from siteloom.operators.spatial import around, cell_degrees
from siteloom.plans.spatial import MASTS, RASTER, SITES, _masts, _raster, _sites
from siteloom.plans.tables import table

STEP, LAT0, LON0, ROWS, COLUMNS = 0.5, 6.0, 67.0, 65, 63


def elevation_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masts with the height of their coordinates, met by a key of six decimals; heights are known on a grid of half degrees, and some are missing."""
    grid = spark.range(ROWS * COLUMNS).select(F.floor(F.col("id") / COLUMNS).alias("r"), F.pmod("id", F.lit(COLUMNS)).alias("c"))
    key = lambda lon, lat: F.format_string("%.6f|%.6f", lon, lat)
    heights = grid.select(key(F.lit(LON0) + F.col("c") * STEP, F.lit(LAT0) + F.col("r") * STEP).alias("key"), F.when((F.col("r") * 7 + F.col("c")) % 13 != 0, F.pmod(F.col("r") * 37 + F.col("c") * 11, F.lit(900)) * 1.5).alias("metres"))
    k = F.col("c_custkey")
    lon, lat = F.lit(LON0) + F.pmod(k * 3, F.lit(COLUMNS)) * STEP, F.lit(LAT0) + F.pmod(k * 5, F.lit(ROWS)) * STEP
    masts = table(spark, sf_dir, "customer").select(k.alias("mast"), key(lon + F.when(k % 10 == 0, 0.0000004).when(k % 10 == 1, 0.00001).otherwise(0.0), lat).alias("key"))
    return masts.join(heights, "key", "left").select("mast", "key", "metres")


ENRICH_SQL = f"""
WITH g AS (SELECT printf('%.6f|%.6f', 67.0::DOUBLE + c * 0.5::DOUBLE, 6.0::DOUBLE + r * 0.5::DOUBLE) AS key, ((r * 37 + c * 11) % 900) * 1.5::DOUBLE AS metres FROM range({ROWS}) AS a(r), range({COLUMNS}) AS b(c) WHERE (r * 7 + c) % 13 <> 0),
m AS (SELECT c_custkey AS mast, printf('%.6f|%.6f', 67.0::DOUBLE + (c_custkey * 3 % {COLUMNS}) * 0.5::DOUBLE + CASE c_custkey % 10 WHEN 0 THEN 0.0000004::DOUBLE WHEN 1 THEN 0.00001::DOUBLE ELSE 0.0::DOUBLE END, 6.0::DOUBLE + (c_custkey * 5 % {ROWS}) * 0.5::DOUBLE) AS key FROM customer)
SELECT mast, key, metres FROM m LEFT JOIN g USING (key)
"""

# What lies around a monument (km) and around a protected core without a zone of its own.
RINGS = [("prohibited_100m", "red", 0.1), ("regulated_300m", "amber", 0.3), ("institution_500m", "amber", 0.5)]
ZONE_KM, CORE_KM = 10.0, 4.0


def buffer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites inside the buffers of monuments, and in the 10 km around cores without a notified zone but outside the core; a buffer is a distance, no polygon."""
    k = F.col("c_custkey")
    marks = _masts(spark, sf_dir).select(F.col("mast").alias("mark"), F.col("plon").alias("blon"), F.col("plat").alias("blat"))
    size = cell_degrees(CORE_KM + ZONE_KM)
    held = marks.withColumns({"cx": F.floor(F.col("blon") / size[0]).cast("int"), "cy": F.floor(F.col("blat") / size[1]).cast("int")})
    near = around(_sites(spark, sf_dir).select("site", (F.col("lon") + 0.001).alias("lon"), F.col("lat")), "lon", "lat", size).join(held, ["cx", "cy"])
    near = near.withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("blon"), F.col("blat"))).where(F.col("km") <= CORE_KM + ZONE_KM)
    rules = [F.when((F.col("mark") % 3 == 0) & (F.col("km") <= r * 20), F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("class"))) for name, kind, r in RINGS]
    zone = F.when((F.col("mark") % 3 == 1) & (F.col("mark") % 4 != 0) & (F.col("km") > CORE_KM), F.struct(F.lit("zone_10km").alias("rule"), F.lit("amber").alias("class")))
    return near.select("site", "mark", "km", F.explode(F.array_compact(F.array(*rules, zone))).alias("r")).groupBy("site", "r.rule", "r.class").agg(F.count("*").alias("marks"), half_up(F.min("km"), 3).alias("nearest_km"))


BUFFER_SQL = f"""
WITH n AS (SELECT site, mast AS mark, {sql_haversine('(lon + 0.001::DOUBLE)', 'lat', 'plon', 'plat')} AS km FROM ({SITES}), ({MASTS}) WHERE abs(lat - plat) < 0.14),
r AS (SELECT site, mark, km, unnest([{', '.join(f"CASE WHEN mark % 3 = 0 AND km <= {r * 20!r}::DOUBLE THEN '{name}|{kind}' END" for name, kind, r in RINGS)}, CASE WHEN mark % 3 = 1 AND mark % 4 <> 0 AND km > 4 THEN 'zone_10km|amber' END]) AS rule FROM n WHERE km <= 14)
SELECT site, split_part(rule, '|', 1) AS rule, split_part(rule, '|', 2) AS class, count(*) AS marks, floor(min(km) * 1000 + 0.5) / 1000 AS nearest_km FROM r WHERE rule IS NOT NULL GROUP BY 1, 2, 3
"""


def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each feature's name stands: the middle of the ring of its largest part."""
    k = F.col("c_custkey")
    lon, lat, w = synthetic_lon(k), synthetic_lat(k * 3), F.lit(0.02) + F.pmod(k * 17, F.lit(50)) / F.lit(1000.0)
    ring = F.array(*[F.struct((lon + dx * w).alias("x"), (lat + dy * w).alias("y")) for dx, dy in ((0, 0), (2, 0), (2, 1), (1, 2), (0, 1))])
    parts = table(spark, sf_dir, "customer").select(F.floor(k / 4).alias("feature"), k.alias("part"), ring.alias("ring")).withColumn("km2", area_km2(F.col("ring")))
    best = parts.groupBy("feature").agg(F.max_by(F.struct("part", "ring", "km2"), F.struct(half_up(F.col("km2"), 6), -F.col("part"))).alias("p"), F.count("*").alias("parts"))
    mean = lambda axis: half_up(F.aggregate(F.col("p.ring"), F.lit(0.0), lambda s, v: s + v[axis]) / F.size("p.ring"), 6)
    return best.select("feature", "parts", F.col("p.part").alias("part"), half_up(F.col("p.km2"), 3).alias("km2"), mean("x").alias("lon"), mean("y").alias("lat"))


_CORNERS = ((0, 0), (2, 0), (2, 1), (1, 2), (0, 1))
LABEL_SQL = f"""
WITH p AS (SELECT c_custkey // 4 AS feature, c_custkey AS part, {sql_lon('c_custkey')} AS lon, {sql_lat('c_custkey * 3')} AS lat, 0.02::DOUBLE + (c_custkey * 17 % 50) / 1000.0::DOUBLE AS w FROM customer),
r AS (SELECT *, [{', '.join(f'lon + {dx} * w' for dx, _ in _CORNERS)}] AS xs, [{', '.join(f'lat + {dy} * w' for _, dy in _CORNERS)}] AS ys FROM p),
a AS (SELECT *, abs({' + '.join(f'radians(xs[{(i + 1) % 5 + 1}] - xs[{i + 1}]) * (2 + sin(radians(ys[{i + 1}])) + sin(radians(ys[{(i + 1) % 5 + 1}])))' for i in range(5))}) * {EARTH_KM}::DOUBLE * {EARTH_KM}::DOUBLE / 2 AS km2 FROM r),
b AS (SELECT *, count(*) OVER (PARTITION BY feature) AS parts, row_number() OVER (PARTITION BY feature ORDER BY floor(km2 * 1e6 + 0.5) DESC, part) AS n FROM a)
SELECT feature, parts, part, floor(km2 * 1000 + 0.5) / 1000 AS km2, floor(list_sum(xs) / 5 * 1e6 + 0.5) / 1e6 AS lon, floor(list_sum(ys) / 5 * 1e6 + 0.5) / 1e6 AS lat FROM b WHERE n = 1
"""

SNAP_DEGREES = 0.4
KINDS = ["Mast", "Mast (PVT)", "Substation"]


def snap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks drawn to the feature of the first kind within the tolerance box, of equal ones the one with the least id, and how far that moved them."""
    clicks = _sites(spark, sf_dir).select("site", "lon", "lat")
    side = SNAP_DEGREES / 4
    marks = _masts(spark, sf_dir).select(F.col("mast").alias("mark"), F.pmod("mast", F.lit(len(KINDS))).alias("kind"), F.col("plon").alias("blon"), F.col("plat").alias("blat"))
    held = marks.withColumns({"cx": F.floor(F.col("blon") / side).cast("int"), "cy": F.floor(F.col("blat") / side).cast("int")})
    # Cells inside the box give their first mark; of those its edge cuts, only the ones with an earlier mark are opened.
    firsts = held.groupBy("cx", "cy").agg(F.min(F.struct("kind", "mark", "blon", "blat")).alias("m"))
    ends = lambda c: F.sequence(F.floor((F.col(c) - SNAP_DEGREES) / side).cast("int") - 1, F.floor((F.col(c) + SNAP_DEGREES) / side).cast("int") + 1)
    cells = clicks.repartition(spread_over(clicks), "site").withColumn("cx", F.explode(ends("lon"))).withColumn("cy", F.explode(ends("lat")))
    within = lambda c, at, slack: (F.col(at) * side >= F.col(c) - SNAP_DEGREES + slack) & ((F.col(at) + 1) * side <= F.col(c) + SNAP_DEGREES - slack)
    met = cells.withColumn("inside", within("lon", "cx", 1e-9) & within("lat", "cy", 1e-9)).join(firsts.hint("shuffle_hash"), ["cx", "cy"])
    sure = met.where("inside").groupBy("site").agg(F.min("m").alias("sure"))
    opened = met.where("NOT inside").select("site", "lon", "lat", "cx", "cy", F.col("m").alias("cell")).join(sure, "site", "left").where(F.col("sure").isNull() | (F.col("cell") < F.col("sure")))
    near = opened.select("site", "lon", "lat", "cx", "cy").join(held.hint("merge"), ["cx", "cy"]).where((F.abs(F.col("lon") - F.col("blon")) <= SNAP_DEGREES) & (F.abs(F.col("lat") - F.col("blat")) <= SNAP_DEGREES))
    first = sure.select("site", F.col("sure").alias("m")).unionByName(near.select("site", F.struct("kind", "mark", "blon", "blat").alias("m"))).groupBy("site").agg(F.min("m").alias("m"))
    rows = clicks.join(first, "site", "left")
    found = F.col("m").isNotNull()
    name = F.when(found, F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("m.kind") + 1).cast("int"))).otherwise("Point")
    moved = F.when(found, haversine_km(F.col("lon"), F.col("lat"), F.col("m.blon"), F.col("m.blat"))).otherwise(0.0)
    return rows.select("site", name.alias("label"), F.col("m.mark").alias("mark"), half_up(moved, 3).alias("moved_km"))


SNAP_SQL = f"""
WITH n AS (SELECT site, lon, lat, mast, plon, plat, row_number() OVER (PARTITION BY site ORDER BY mast % 3, mast) AS k FROM ({SITES}) JOIN ({MASTS}) ON abs(lon - plon) <= {SNAP_DEGREES} AND abs(lat - plat) <= {SNAP_DEGREES})
SELECT s.site, coalesce({KINDS!r}[CAST(mast % 3 + 1 AS INT)], 'Point') AS label, mast AS mark, floor(CASE WHEN mast IS NULL THEN 0.0::DOUBLE ELSE {sql_haversine('n.lon', 'n.lat', 'plon', 'plat')} END * 1000 + 0.5) / 1000 AS moved_km
FROM ({SITES}) s LEFT JOIN n ON n.site = s.site AND k = 1
"""

BANDS, LOW, HIGH = 40, 0.0, 3010.0
STOPS = [(0.0, (20, 40, 120)), (0.25, (30, 150, 180)), (0.5, (90, 190, 80)), (0.75, (240, 190, 60)), (1.0, (200, 40, 40))]  # of the sample ramp


def wind_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by band of their value, with the colour at the band's middle; pixels without a value are clear."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("z") - LOW) / (HIGH - LOW)))
    n = _raster(spark, sf_dir).groupBy(F.when(F.col("z").isNotNull(), F.least(F.lit(BANDS - 1), F.floor(t * BANDS).cast("int"))).alias("band")).agg(F.count("*").alias("pixels"))
    at = (F.col("band") + 0.5) / BANDS

    def channel(i: int):
        out = F.lit(float(STOPS[-1][1][i]))
        for (t0, c0), (t1, c1) in reversed(list(zip(STOPS, STOPS[1:], strict=False))):
            out = F.when(at <= t1, F.lit(float(c0[i])) + F.lit(float(c1[i] - c0[i])) * ((at - t0) / (t1 - t0))).otherwise(out)
        return F.floor(out + 0.5).cast("int")

    colour = F.when(F.col("band").isNotNull(), F.format_string("rgb(%d,%d,%d)", *[channel(i) for i in range(3)])).otherwise("clear")
    return n.select("band", "pixels", colour.alias("colour"))


def _channel_sql(i: int) -> str:
    parts = " ".join(f"WHEN p <= {t1}::DOUBLE THEN {c0[i]}.0::DOUBLE + {c1[i] - c0[i]}.0::DOUBLE * ((p - {t0}::DOUBLE) / {t1 - t0}::DOUBLE)" for (t0, c0), (t1, c1) in zip(STOPS, STOPS[1:], strict=False))
    return f"CAST(floor(CASE {parts} END + 0.5) AS INT)"


BANDS_SQL = f"""
WITH b AS (SELECT CAST(least({BANDS - 1}, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, z / {HIGH}::DOUBLE)) * {BANDS})) AS INT) AS band, z IS NULL AS none FROM ({RASTER})),
n AS (SELECT CASE WHEN none THEN NULL ELSE band END AS band, count(*) AS pixels FROM b GROUP BY 1)
SELECT band, pixels, CASE WHEN band IS NULL THEN 'clear' ELSE 'rgb(' || {_channel_sql(0)} || ',' || {_channel_sql(1)} || ',' || {_channel_sql(2)} || ')' END AS colour FROM (SELECT *, (band + 0.5::DOUBLE) / {BANDS} AS p FROM n)
"""

SCALE, FINE = 10, 4


def regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster on a grid four times as fine: bilinear between the four pixels around, as whole tenths; 0 where one of them has no value. Each pixel goes to the four squares it is a corner of, and a square makes its points."""
    pixels = _raster(spark, sf_dir).where("z IS NOT NULL")
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    sent = pixels.select("z", F.explode(F.array(*[F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("c"), F.lit(2 * i + j).alias("corner")) for i, j in corners])).alias("p")).select("z", "p.*")
    squares = sent.groupBy("r", "c").agg(*[F.sum(F.when(F.col("corner") == k, F.col("z"))).alias(f"s{k}") for k in range(4)], *[F.count_if(F.col("corner") == k).alias(f"n{k}") for k in range(4)])

    def point(a: int, b: int) -> Column:
        """A square's point, ``a`` and ``b`` steps from its first corner: its weight and sum, null where no pixel touches it."""
        shares = [((FINE - a if not i else a) * (FINE - b if not j else b) / FINE**2, 2 * i + j) for i, j in corners]
        w = sum((F.lit(share) * F.col(f"n{k}") for share, k in shares if share), F.lit(0.0))
        s = sum((F.lit(share) * F.coalesce(f"s{k}", F.lit(0.0)) for share, k in shares if share), F.lit(0.0))
        return F.when(w > 0, F.when(w > 0.999999, F.floor(s * SCALE + 0.5)).otherwise(0).cast("long"))

    points = squares.select(F.floor(F.col("r") / 4).cast("int").alias("block"), F.explode(F.array(*[point(a, b) for a in range(FINE) for b in range(FINE)])).alias("v")).where("v IS NOT NULL")
    return points.groupBy("block").agg(F.count("*").alias("points"), F.count(F.when(F.col("v") > 0, 1)).alias("known"), F.sum("v").alias("total"), F.max("v").alias("most"))


REGRID_SQL = f"""
WITH s AS (SELECT row * 4 + dr AS r, col * 4 + dc AS c, (4.0::DOUBLE - abs(dr)) / 4 * ((4.0::DOUBLE - abs(dc)) / 4) AS w, z FROM ({RASTER}), range(-3, 4) AS a(dr), range(-3, 4) AS b(dc) WHERE z IS NOT NULL),
p AS (SELECT r, CASE WHEN sum(w) > 0.999999 THEN CAST(floor(sum(w * z) * {SCALE} + 0.5) AS BIGINT) ELSE 0 END AS v FROM s GROUP BY r, c)
SELECT CAST(floor(r / 16.0::DOUBLE) AS INT) AS block, count(*) AS points, count(CASE WHEN v > 0 THEN 1 END) AS known, CAST(sum(v) AS BIGINT) AS total, max(v) AS most FROM p GROUP BY 1
"""


def mask_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A land mask closed by one pixel (dilated, then eroded), and the fringe around it: what dilation by two adds, without land and foreign pixels."""
    k = F.col("row") * 64 + F.col("col")
    cells = _raster(spark, sf_dir).select("row", "col", (F.pmod(k * 7 + F.col("row"), F.lit(11)) < 5).alias("land"), (F.pmod(k, F.lit(17)) == 0).alias("foreign"))
    square = lambda n: [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1)]

    def spread(rows: DataFrame, n: int) -> DataFrame:
        return rows.select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in square(n)])).alias("p")).select("p.*")

    land = cells.where("land").select("row", "col")
    wide = spread(land, 1).distinct()
    closed = spread(wide, 1).groupBy("row", "col").agg(F.count("*").alias("n")).where("n = 9").select("row", "col", F.lit(True).alias("closed"))
    reach = spread(land, 2).distinct().withColumn("reach", F.lit(True))
    rows = cells.join(closed, ["row", "col"], "left").join(reach, ["row", "col"], "left")
    fringe = F.coalesce("reach", F.lit(False)) & ~F.col("land") & ~F.col("foreign")
    return rows.groupBy(F.floor(F.col("row") / 8).cast("int").alias("block")).agg(F.count_if("land").alias("land"), F.count("closed").alias("closed"), F.count_if(fringe).alias("fringe"))


FRINGE_SQL = f"""
WITH c AS (SELECT row, col, ((row * 64 + col) * 7 + row) % 11 < 5 AS land, (row * 64 + col) % 17 = 0 AS foreign_ FROM ({RASTER})), o AS (SELECT i, j FROM range(-1, 2) AS a(i), range(-1, 2) AS b(j)),
w AS (SELECT DISTINCT row + i AS row, col + j AS col FROM c, o WHERE land), e AS (SELECT row + i AS row, col + j AS col FROM w, o GROUP BY 1, 2 HAVING count(*) = 9),
t AS (SELECT DISTINCT row + i AS row, col + j AS col FROM c, range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE land)
SELECT CAST(c.row // 8 AS INT) AS block, count(*) FILTER (land) AS land, count(e.row) AS closed, count(*) FILTER (t.row IS NOT NULL AND NOT land AND NOT foreign_) AS fringe
FROM c LEFT JOIN e ON e.row = c.row AND e.col = c.col LEFT JOIN t ON t.row = c.row AND t.col = c.col GROUP BY 1
"""

HALVINGS = 60


def _moment_ratio(k):
    """E[v**3] / E[v]**3 of a Weibull law of shape k, by Stirling's series for both gammas."""
    log_gamma = lambda x: (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    shifted = lambda x: log_gamma(x + 6) - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    return F.exp(shifted(1 + 3 / k) - 3 * shifted(1 + 1 / k))


def weibull_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and scale of the wind law with each site's mean speed and power density, by halving the shape between 1 and 6."""
    k = F.col("s_suppkey")
    mean = F.lit(4.0) + F.pmod(k * 7, F.lit(500)) / F.lit(100.0)
    power = F.lit(0.5 * 1.225) * F.pow(mean, F.lit(3.0)) * (F.lit(1.3) + F.pmod(k * 11, F.lit(150)) / F.lit(100.0))
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), mean.alias("mean"), power.alias("power")).withColumn("ratio", F.col("power") / (F.lit(0.5 * 1.225) * F.pow("mean", F.lit(3.0))))
    ends = F.struct(F.lit(1.0).alias("lo"), F.lit(6.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        over = _moment_ratio(mid) > F.col("ratio")  # the ratio falls with the shape
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    found = rows.withColumn("e", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halve)).withColumn("k", (F.col("e.lo") + F.col("e.hi")) / 2)
    return found.select("site", half_up(F.col("k"), 5).alias("k"), half_up(F.col("ratio"), 6).alias("ratio"), half_up(_moment_ratio(F.col("k")), 6).alias("again"))


def _ratio_sql(k: str) -> str:
    return f"gamma(1 + 3 / {k}) / pow(gamma(1 + 1 / {k}), 3)"


WEIBULL_SQL = f"""
WITH RECURSIVE s AS (SELECT s_suppkey AS site, 4.0::DOUBLE + (s_suppkey * 7 % 500) / 100.0::DOUBLE AS mean, 1.3::DOUBLE + (s_suppkey * 11 % 150) / 100.0::DOUBLE AS given FROM supplier),
p AS (SELECT site, 0.6125::DOUBLE * pow(mean, 3) * given / (0.6125::DOUBLE * pow(mean, 3)) AS ratio FROM s),
b AS (SELECT site, ratio, 0 AS n, 1.0::DOUBLE AS lo, 6.0::DOUBLE AS hi FROM p
  UNION ALL SELECT site, ratio, n + 1, CASE WHEN {_ratio_sql('((lo + hi) / 2)')} > ratio THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_ratio_sql('((lo + hi) / 2)')} > ratio THEN hi ELSE (lo + hi) / 2 END FROM b WHERE n < {HALVINGS})
SELECT site, floor((lo + hi) / 2 * 1e5 + 0.5) / 1e5 AS k, floor(ratio * 1e6 + 0.5) / 1e6 AS ratio, floor({_ratio_sql('((lo + hi) / 2)')} * 1e6 + 0.5) / 1e6 AS again FROM b WHERE n = {HALVINGS}
"""

QUERIES = {f.__name__: f for f in (elevation_enrichment, buffer_rules, label_points, snap_points, wind_bands, regrid, mask_fringe, weibull_inversion)}
SQL = {"elevation_enrichment": ENRICH_SQL, "buffer_rules": BUFFER_SQL, "label_points": LABEL_SQL, "snap_points": SNAP_SQL, "wind_bands": BANDS_SQL, "regrid": REGRID_SQL, "mask_fringe": FRINGE_SQL, "weibull_inversion": WEIBULL_SQL}
