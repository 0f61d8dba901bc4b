"""The whole analysis of areas as one query, and the lookups and comparisons it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions.geo import EARTH_KM, haversine_km, sql_haversine, sql_lat, sql_lon, synthetic_lat, synthetic_lon
from siteloom.functions.numeric import half_up
from siteloom.operators import shapes
from siteloom.operators.coverage import ring_km2
from siteloom.operators.dedupe import latest
from siteloom.operators.ranking import quantiles
from siteloom.plans import finance, policy, spatial, wind, zones
from siteloom.plans.spatial import AREAS, SITES, TURBINES, _areas, _sites, _turbines
from siteloom.plans.tables import table


OFF = 0.00037


def states_of_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that an area's middle or one of its corners lies in, each once. Areas stand a little off the round degrees of the states' borders, on which membership is open."""
    sites = _sites(spark, sf_dir).select("site", zones.shape(F.col("lon") + OFF, F.col("lat"), zones.AREA).alias("ring"))
    mean = lambda axis: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[axis]) / F.size("ring")
    samples = sites.select("site", F.explode(F.concat("ring", F.array(F.struct(mean("x").alias("x"), mean("y").alias("y"))))).alias("p")).select("site", F.col("p.x").alias("plon"), F.col("p.y").alias("plat"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("state"))
    hit = spatial.in_areas(samples, _areas(spark, sf_dir)).select("site", "area").distinct()
    return hit.join(names, "area").select("site", "state")


_MEAN = [sum(c[i] for c in zones.AREA) / len(zones.AREA) for i in (0, 1)]
STATES_SQL = f"""
WITH p AS (SELECT site, unnest(list_append({zones.sql_shape(f'lon + {OFF}::DOUBLE', 'lat', zones.AREA)}, {{'x': lon + {OFF}::DOUBLE + {_MEAN[0]!r}::DOUBLE, 'y': lat + {_MEAN[1]!r}::DOUBLE}})) AS p FROM ({SITES}))
SELECT DISTINCT site, n_name AS state FROM p JOIN ({AREAS}) a ON abs(p.x - a.x) + abs(p.y - a.y) < r JOIN nation ON n_nationkey = area
"""


def turbine_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turbine with the one district that holds it, of several the least, or none."""
    turbines = _turbines(spark, sf_dir).select("turbine", "plon", "plat", "kw")
    held = spatial.in_areas(turbines, _areas(spark, sf_dir)).groupBy("turbine").agg(F.min("area").alias("district"))
    return turbines.join(held, "turbine", "left").select("turbine", "kw", "district")


HELD_SQL = f"SELECT turbine, any_value(kw) AS kw, min(area) AS district FROM ({TURBINES}) LEFT JOIN ({AREAS}) ON abs(plon - x) + abs(plat - y) < r GROUP BY turbine"

#: Fixed values of a layout's square (km): its least side, and the margin around the farthest turbine; and the least area of a hull.
LEAST_SIDE, MARGIN, LEAST_KM2 = 5.0, 0.5, 1.0


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as turbines of farms: full ones, pairs, single ones and rows in a line."""
    k = F.col("c_custkey")
    farm, i = F.floor(k / 8), F.pmod(k, F.lit(8))
    kind = F.pmod(farm, F.lit(4))
    x, y = F.floor(synthetic_lon(farm * 31) * 1000), F.floor(synthetic_lat(farm * 37) * 1000)
    dx = F.when(kind == 2, i * 9).otherwise(F.pmod(k * 37, F.lit(90)))
    dy = F.when(kind == 2, i * 9).when(kind == 3, F.pmod(k * 53, F.lit(3))).otherwise(F.pmod(k * 71, F.lit(70)))
    rows = table(spark, sf_dir, "customer").where((kind != 1) | (i < 2)).select(farm.alias("farm"), (x + dx).alias("x"), (y + dy).alias("y"))
    return rows.where((F.pmod("farm", F.lit(12)) != 5) | (F.pmod(F.col("x"), F.lit(2)) == 0))


def layout_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to screen of each farm: the hull of its turbines where there are three and it has a square kilometre, else a square around them all; with its area and the middle of its area."""
    rows = _layout(spark, sf_dir)
    rings = shapes.hull_rings(rows, "farm", "x", "y").select("farm", F.transform("hull", lambda p: F.struct((p["x"] / 1000).alias("x"), (p["y"] / 1000).alias("y"))).alias("hull"))
    sums = rows.groupBy("farm").agg(F.count("*").alias("turbines"), (F.sum("x") / F.count("*") / 1000).alias("cx"), (F.sum("y") / F.count("*") / 1000).alias("cy"))
    far = rows.join(sums, "farm").groupBy("farm").agg(F.max(haversine_km(F.col("cx"), F.col("cy"), F.col("x") / 1000, F.col("y") / 1000)).alias("far"))
    met = rings.join(sums, "farm").join(far, "farm")
    good = (F.col("turbines") >= 3) & (F.size("hull") >= 3) & (ring_km2(F.col("hull")) >= LEAST_KM2)
    side = F.greatest(F.lit(LEAST_SIDE), 2 * F.col("far") + 2 * MARGIN)
    dy, dx = side / 2 / 110.574, side / 2 / (F.lit(111.32) * F.cos(F.radians("cy")))
    at = lambda a, b: F.struct((F.col("cx") + a * dx).alias("x"), (F.col("cy") + b * dy).alias("y"))
    ring = F.when(good, F.col("hull")).otherwise(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)))
    chosen = met.select("farm", "turbines", F.when(good, "hull").otherwise("square").alias("shape"), ring.alias("ring"))
    n = F.size("ring")
    next_ = lambda i: F.get("ring", F.pmod(i + 1, n))
    first = F.get("ring", F.lit(0))
    cross = lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"])
    total = lambda f: F.aggregate(F.transform("ring", f), F.lit(0.0), lambda s, v: s + v)
    middle = lambda axis: first[axis] + total(lambda p, i: (p[axis] + next_(i)[axis] - 2 * first[axis]) * cross(p, next_(i))) / (3 * total(lambda p, i: cross(p, next_(i))))
    return chosen.select("farm", "turbines", "shape", n.alias("corners"), half_up(ring_km2(F.col("ring")), 3).alias("km2"), half_up(middle("x"), 5).alias("lon"), half_up(middle("y"), 5).alias("lat"))


SCREENS_SQL = f"""
WITH c AS (SELECT c_custkey AS k, c_custkey // 8 AS farm, c_custkey % 8 AS i FROM customer),
t AS (SELECT farm, CAST(floor({sql_lon('farm * 31')} * 1000) AS BIGINT) + CASE WHEN farm % 4 = 2 THEN i * 9 ELSE k * 37 % 90 END AS x, CAST(floor({sql_lat('farm * 37')} * 1000) AS BIGINT) + CASE WHEN farm % 4 = 2 THEN i * 9 WHEN farm % 4 = 3 THEN k * 53 % 3 ELSE k * 71 % 70 END AS y FROM c WHERE farm % 4 <> 1 OR i < 2),
r AS (SELECT * FROM t WHERE farm % 12 <> 5 OR x % 2 = 0), p AS (SELECT DISTINCT farm, x, y FROM r),
e AS (SELECT a.farm, a.x, a.y, b.x AS nx, b.y AS ny FROM p a JOIN p b ON a.farm = b.farm AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.farm = a.farm AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) NOT BETWEEN 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))))),
h AS (SELECT farm, count(*) AS corners, abs(sum(radians((nx - x) / 1000::DOUBLE) * {zones.sql_under('(y / 1000::DOUBLE)', '(ny / 1000::DOUBLE)')})) * {EARTH_KM}::DOUBLE * {EARTH_KM}::DOUBLE AS km2,
  sum((x + nx) * (x * ny - nx * y)::DOUBLE) / (3 * sum((x * ny - nx * y)::DOUBLE)) / 1000 AS mx, sum((y + ny) * (x * ny - nx * y)::DOUBLE) / (3 * sum((x * ny - nx * y)::DOUBLE)) / 1000 AS my FROM e GROUP BY farm),
s AS (SELECT farm, count(*) AS turbines, sum(x)::DOUBLE / count(*) / 1000 AS cx, sum(y)::DOUBLE / count(*) / 1000 AS cy FROM r GROUP BY farm),
f AS (SELECT r.farm, greatest({LEAST_SIDE}::DOUBLE, 2 * max({sql_haversine('cx', 'cy', '(x / 1000::DOUBLE)', '(y / 1000::DOUBLE)')}) + {2 * MARGIN}::DOUBLE) AS side FROM r JOIN s USING (farm) GROUP BY r.farm),
q AS (SELECT s.farm, turbines, cx, cy, side / 2 / 110.574::DOUBLE AS dy, side / 2 / (111.32::DOUBLE * cos(radians(cy))) AS dx, turbines >= 3 AND coalesce(corners, 0) >= 3 AND coalesce(km2, 0) >= {LEAST_KM2} AS good, corners, km2, mx, my FROM s JOIN f USING (farm) LEFT JOIN h USING (farm))
SELECT farm, turbines, CASE WHEN good THEN 'hull' ELSE 'square' END AS shape, CAST(CASE WHEN good THEN corners ELSE 4 END AS INT) AS corners,
  floor(CASE WHEN good THEN km2 ELSE radians(2 * dx) * (sin(radians(cy + dy)) - sin(radians(cy - dy))) * {EARTH_KM}::DOUBLE * {EARTH_KM}::DOUBLE END * 1000 + 0.5) / 1000 AS km2,
  floor(CASE WHEN good THEN mx ELSE cx END * 1e5 + 0.5) / 1e5 AS lon, floor(CASE WHEN good THEN my ELSE cy END * 1e5 + 0.5) / 1e5 AS lat FROM q
"""

#: The kind of each dimension, with the unit of numbers and the order of a choice, worst first; and the rubric: weight, and what is better.
KINDS = {"1-URGENT": ("numeric", "₹/kWh"), "2-HIGH": ("boolean", None), "3-MEDIUM": ("enum", None), "4-NOT SPECIFIED": ("text", None), "5-LOW": ("numeric", "%")}
CHOICES = ("none", "partial", "full")
WEIGHTS = {"1-URGENT": (3, "lower"), "2-HIGH": (2, True), "3-MEDIUM": (2, None), "4-NOT SPECIFIED": (1, None), "5-LOW": (2, "higher")}
GRADES = ((80, "A"), (65, "B"), (50, "C"), (35, "D"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each dimension of a jurisdiction: a number, a flag, a choice, a text, or, where a number is due, a rule."""
    now = latest(policy._values(spark, sf_dir), ["jurisdiction", "dimension"], "year", "id")
    i = F.col("id")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, (v, _) in KINDS.items() for x in (k, v)]), F.col("dimension"))
    of = lambda k, v: F.when(kind == k, v)
    return now.select(
        "jurisdiction", "dimension", "year", kind.alias("kind"), of("numeric", F.when(F.pmod(i, F.lit(6)) != 0, F.floor(F.col("number") / 10) / 100)).alias("number"), of("boolean", F.when(F.pmod(i, F.lit(5)) != 0, F.pmod(i, F.lit(2)) == 0)).alias("flag"),
        of("enum", F.when(F.pmod(i, F.lit(7)) != 0, F.element_at(F.array(*[F.lit(c) for c in CHOICES]), (F.pmod(i, F.lit(3)) + 1).cast("int")))).alias("choice"), F.when((kind == "text") | (kind == "numeric"), F.when(F.pmod(i, F.lit(4)) != 3, F.concat(F.lit("clause "), F.pmod(i, F.lit(9))))).alias("text"),
    )


def policy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every jurisdiction's value of every dimension as it is shown, and how it differs from that of jurisdiction 0, by the dimension's kind."""
    cells = _cells(spark, sf_dir)
    rule = (F.col("kind") == "numeric") & F.col("number").isNull() & F.col("text").isNotNull()
    unit = F.element_at(F.create_map(*[F.lit(x) for k, (_, u) in KINDS.items() if u for x in (k, u)]), F.col("dimension"))
    number = F.when(unit == "₹/kWh", F.format_string("₹%.2f/kWh", "number")).otherwise(F.format_string("%.2f%%", "number"))
    shown = F.coalesce(F.when(rule, F.col("text")), F.when(F.col("kind") == "numeric", number_or_null(number)), F.when(F.col("flag"), "Yes").when(~F.col("flag"), "No"), F.col("choice"), F.when(F.col("kind") == "text", F.col("text")), F.lit("—"))
    value = F.when(F.col("kind") == "boolean", F.col("flag").cast("string")).when(F.col("kind") == "enum", F.col("choice"))
    own = cells.withColumns({"rule": rule, "shown": shown, "value": value})
    base = own.where("jurisdiction = 0").select("dimension", F.col("number").alias("base_number"), F.col("value").alias("base_value"))  # a row for each dimension
    met = own.join(F.broadcast(base), "dimension", "left")
    note = (
        F.when(F.col("kind") == "text", "text").when((F.col("kind") == "numeric") & F.col("rule"), "rule-based, not numerically comparable").when((F.col("kind") == "numeric") & F.col("number").isNull(), None)
        .when((F.col("kind") == "numeric") & F.col("base_number").isNull(), "no national baseline").when(F.col("kind") == "numeric", "numeric").when(F.col("base_value").isNull(), "no_baseline").when(F.col("value").isNull(), "state_silent")
        .when(F.col("value") == F.col("base_value"), "aligned").otherwise("differs")
    )
    return met.select("jurisdiction", "dimension", "year", "shown", half_up(F.col("number") - F.col("base_number"), 4).alias("delta"), note.alias("note"))


def number_or_null(shown):
    """What a number looks like, null where there is none."""
    return F.when(F.col("number").isNotNull(), shown)


def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, grade, coverage and rank of every jurisdiction: flags count if as wanted, choices by their place, texts if they are there, numbers between the least and the most of all."""
    cells = _cells(spark, sf_dir)
    pick = lambda at, kind: F.element_at(F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() if v[at] is not None and not isinstance(v[at], bool) for x in (k, v[at])]), F.col("dimension")).cast(kind)
    ends = cells.groupBy("dimension").agg(F.min("number").alias("low"), F.max("number").alias("high"))  # a row for each dimension
    rows = cells.join(F.broadcast(ends), "dimension").withColumns({"weight": pick(0, "int"), "better": pick(1, "string")})
    norm = (F.col("number") - F.col("low")) / (F.col("high") - F.col("low"))
    place = (F.array_position(F.array(*[F.lit(c) for c in CHOICES]), F.col("choice")) - 1) / float(len(CHOICES) - 1)
    sub = (
        F.when(F.col("kind") == "boolean", F.when(F.col("flag").isNotNull(), F.col("flag").cast("int").cast("double"))).when(F.col("kind") == "enum", F.when(F.col("choice").isNotNull(), place))
        .when(F.col("kind") == "text", F.when(F.trim("text") != "", 1.0)).otherwise(F.when(F.col("number").isNotNull(), F.when(F.col("high") == F.col("low"), 0.5).when(F.col("better") == "higher", norm).otherwise(1 - norm)))
    )
    scored = rows.withColumn("sub", sub)
    sums = scored.groupBy("jurisdiction").agg(F.sum(F.when(F.col("sub").isNotNull(), F.col("sub") * F.col("weight"))).alias("got"), F.sum(F.when(F.col("sub").isNotNull(), F.col("weight"))).alias("covered"))
    score = F.coalesce(half_up(F.col("got") / F.col("covered") * 100, 1), F.lit(0.0))
    grade = F.lit("F")
    for least, letter in reversed(GRADES):
        grade = F.when(F.col("score") >= least, letter).otherwise(grade)
    out = sums.withColumn("score", score).select("jurisdiction", "score", grade.alias("grade"), half_up(F.coalesce("covered", F.lit(0)) / float(sum(w for w, _ in WEIGHTS.values())), 2).alias("coverage"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "jurisdiction")))  # a row for each jurisdiction


def _case(of: dict, column: str = "dimension") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in of.items()) + " END"


CELLS_SQL = f"""
WITH l AS (SELECT *, {_case({k: v for k, (v, _) in KINDS.items()})} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction, dimension ORDER BY year DESC, id) AS n FROM ({policy.VALUES})) WHERE n = 1),
c AS (SELECT jurisdiction, dimension, year, kind, CASE WHEN kind = 'numeric' AND id % 6 <> 0 THEN floor(number / 10) / 100 END AS number, CASE WHEN kind = 'boolean' AND id % 5 <> 0 THEN id % 2 = 0 END AS flag,
  CASE WHEN kind = 'enum' AND id % 7 <> 0 THEN {list(CHOICES)!r}[CAST(id % 3 + 1 AS INT)] END AS choice, CASE WHEN kind IN ('text', 'numeric') AND id % 4 <> 3 THEN 'clause ' || (id % 9) END AS text FROM l)"""
POLICY_CELLS_SQL = CELLS_SQL + """, v AS (SELECT *, kind = 'numeric' AND number IS NULL AND text IS NOT NULL AS rule, CASE kind WHEN 'boolean' THEN CAST(flag AS VARCHAR) WHEN 'enum' THEN choice END AS value FROM c),
b AS (SELECT dimension, number AS bn, value AS bv FROM v WHERE jurisdiction = 0)
SELECT jurisdiction, v.dimension, year,
  coalesce(CASE WHEN rule THEN text END, CASE WHEN number IS NOT NULL THEN CASE WHEN v.dimension = '1-URGENT' THEN printf('₹%.2f/kWh', number) ELSE printf('%.2f%%', number) END END, CASE WHEN flag THEN 'Yes' WHEN NOT flag THEN 'No' END, choice, CASE WHEN kind = 'text' THEN text END, '—') AS shown,
  floor((number - bn) * 10000 + 0.5) / 10000 AS delta,
  CASE WHEN kind = 'text' THEN 'text' WHEN rule THEN 'rule-based, not numerically comparable' WHEN kind = 'numeric' AND number IS NULL THEN NULL WHEN kind = 'numeric' AND bn IS NULL THEN 'no national baseline' WHEN kind = 'numeric' THEN 'numeric'
    WHEN bv IS NULL THEN 'no_baseline' WHEN value IS NULL THEN 'state_silent' WHEN value = bv THEN 'aligned' ELSE 'differs' END AS note FROM v LEFT JOIN b ON b.dimension = v.dimension
"""
POLICY_SCORES_SQL = CELLS_SQL + f""", e AS (SELECT dimension, min(number) AS low, max(number) AS high FROM c GROUP BY 1),
s AS (SELECT jurisdiction, {_case({k: w for k, (w, _) in WEIGHTS.items()}, 'c.dimension')} AS weight, CASE kind WHEN 'boolean' THEN CAST(flag AS INT)::DOUBLE WHEN 'enum' THEN (list_position({list(CHOICES)!r}, choice) - 1) / {len(CHOICES) - 1}.0::DOUBLE WHEN 'text' THEN CASE WHEN trim(text) <> '' THEN 1.0::DOUBLE END
  ELSE CASE WHEN number IS NULL THEN NULL WHEN high = low THEN 0.5::DOUBLE WHEN c.dimension = '5-LOW' THEN (number - low) / (high - low) ELSE 1 - (number - low) / (high - low) END END AS sub FROM c JOIN e ON e.dimension = c.dimension),
g AS (SELECT jurisdiction, coalesce(floor(sum(sub * weight) / sum(weight) FILTER (sub IS NOT NULL) * 100 * 10 + 0.5) / 10, 0) AS score, floor(coalesce(sum(weight) FILTER (sub IS NOT NULL), 0) / {sum(w for w, _ in WEIGHTS.values())}.0::DOUBLE * 100 + 0.5) / 100 AS coverage FROM s GROUP BY 1)
SELECT jurisdiction, score, CASE {' '.join(f"WHEN score >= {n} THEN '{c}'" for n, c in GRADES)} ELSE 'F' END AS grade, coverage, CAST(row_number() OVER (ORDER BY score DESC, jurisdiction) AS INT) AS rank FROM g
"""


def line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each priority by price: how many, the least, the median, the 90th and 99th percentile, the most."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    names = {0.5: "p50", 0.9: "p90", 0.99: "p99"}
    places = quantiles(rows, "o_totalprice", list(names), "o_orderpriority").groupBy("o_orderpriority").agg(*[half_up(F.max(F.when(F.col("share") == s, F.col("o_totalprice"))), 2).alias(n) for s, n in names.items()])
    sums = rows.groupBy("o_orderpriority").agg(F.count("o_totalprice").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    return sums.join(places, "o_orderpriority")


LINE_REPORT_SQL = f"SELECT o_orderpriority, count(o_totalprice) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, {', '.join(f'floor(quantile_cont(o_totalprice, {s}) * 100 + 0.5) / 100 AS {n}' for s, n in ((0.5, 'p50'), (0.9, 'p90'), (0.99, 'p99')))} FROM orders GROUP BY 1"


def line_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantities by flag, status and year of shipping in every combination, and how many parts they are of."""
    rows = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    by = ["l_returnflag", "l_linestatus", "year"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    cube = sums.cube(*by).agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"), F.grouping_id().cast("long").alias("level"))
    # A part is shuffled once, with the few combinations it has, and counts once in each of their cells.
    held = rows.where("l_partkey IS NOT NULL").groupBy("l_partkey").agg(F.collect_set(F.struct(*by)).alias("held"))

    def at(level: int) -> Column:
        """The held combinations without what the level leaves out."""
        kept = lambda c, i: F.when(F.lit(level >> (len(by) - 1 - i) & 1) == 0, c[by[i]]).alias(by[i])
        return F.array_distinct(F.transform("held", lambda c: F.struct(F.lit(level).cast("long").alias("level"), *[kept(c, i) for i in range(len(by))])))

    cells = F.flatten(F.array(*[at(level) for level in range(2 ** len(by))]))
    parts = held.select(F.explode(cells).alias("c")).groupBy("c").agg(F.count("*").alias("parts")).select(*[F.col(f"c.{k}").alias(f"of_{k}") for k in ("level", *by)], "parts")
    same = F.col("level") == F.col("of_level")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return cube.join(parts, same, "left").select(*by, "n", "quantity", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"), "level")


LINE_CUBE_SQL = """
SELECT l_returnflag, l_linestatus, year, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_partkey) AS parts, CAST(grouping(l_returnflag, l_linestatus, year) AS BIGINT) AS level
FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS year FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus, year)
"""


def aoi_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about each area in one row: its wind and yield, what of it is excluded by the exact union of zones, grid, masts, turbine capacity nearby, states, and returns. Parts that an area has none of are null."""
    one = lambda q, *columns: q(spark, sf_dir).select("site", *columns)
    out = one(wind.screening_score_rank, "cuf", "score", "rating", "rank")
    parts = [
        one(wind.shear_fit_by_site, "shear"), one(wind.powercurve_cf, "net_p50", "net_p75", "net_p90"), one(wind.developable_sizing, "mw", "gwh"),
        one(spatial.masts_within_radius, "n25", "confidence"), one(spatial.nearest_mast, F.col("mast").alias("nearest_mast"), F.col("km").alias("mast_km")), one(spatial.nearest_line_segment, F.col("km").alias("line_km"), "kv", "high_voltage"),
        one(finance.cashflow_irr, "equity_irr", "payback"), one(finance.bankability_dcf, "min_cover", "verdict"), one(finance.nearby_better_site, F.col("score").alias("nearby_score"), "ring_km"),
        states_of_areas(spark, sf_dir).groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states")),
    ]
    union = zones.exclusion_union(spark, sf_dir).where("layer = 'all'")
    parts.append(union.groupBy("site").agg(*[F.max(F.when(F.col("class") == c, F.col(v))).alias(f"{c}_{v}") for c in ("red", "amber") for v in ("km2", "share")]))
    for part in parts:
        out = out.join(part, "site", "left")
    return out


def _all_sql() -> str:
    own = {**wind.SQL, **spatial.SQL, **finance.SQL, **zones.SQL}
    picked = [
        ("shear_fit_by_site", "shear"), ("powercurve_cf", "net_p50, net_p75, net_p90"), ("developable_sizing", "mw, gwh"), ("masts_within_radius", "n25, confidence"), ("nearest_mast", "mast AS nearest_mast, km AS mast_km"),
        ("nearest_line_segment", "km AS line_km, kv, high_voltage"), ("cashflow_irr", "equity_irr, payback"), ("bankability_dcf", "min_cover, verdict"), ("nearby_better_site", "score AS nearby_score, ring_km"),
    ]
    joins = " ".join(f"LEFT JOIN (SELECT site, {columns} FROM ({own[name]})) USING (site)" for name, columns in picked)
    by = ", ".join(f"max({v}) FILTER (class = '{c}') AS {c}_{v}" for c in ("red", "amber") for v in ("km2", "share"))
    return f"""SELECT * FROM (SELECT site, cuf, score, rating, rank FROM ({own['screening_score_rank']})) {joins} LEFT JOIN (SELECT site, array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM ({STATES_SQL}) GROUP BY site) USING (site)
LEFT JOIN (SELECT site, {by} FROM ({own['exclusion_union']}) WHERE layer = 'all' GROUP BY site) USING (site)"""


QUERIES = {f.__name__: f for f in (aoi_analysis, states_of_areas, turbine_districts, layout_screens, policy_cells, policy_scores, line_report, line_cube)}
SQL = {"aoi_analysis": _all_sql(), "states_of_areas": STATES_SQL, "turbine_districts": HELD_SQL, "layout_screens": SCREENS_SQL, "policy_cells": POLICY_CELLS_SQL, "policy_scores": POLICY_SCORES_SQL, "line_report": LINE_REPORT_SQL, "line_cube": LINE_CUBE_SQL}
