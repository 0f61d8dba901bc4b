"""Versioned policy tables, merging of sources, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions.numeric import half_up
from siteloom.operators.dedupe import keep_first, latest, overlay
from siteloom.plans.tables import table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of policy values: a jurisdiction, a dimension, a year and a number that may be missing."""
    return table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(25)).cast("int").alias("jurisdiction"), F.col("o_orderpriority").alias("dimension"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("number"), F.col("o_orderkey").alias("id"))


VALUES = "SELECT CAST(o_custkey % 25 AS INT) AS jurisdiction, o_orderpriority AS dimension, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS number, o_orderkey AS id FROM orders"


def latest_policy_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version up to 1998 of each value, and the latest that has a number."""
    values = _values(spark, sf_dir)
    any_kind = latest(values, ["jurisdiction", "dimension"], "year", "id", 1998)
    known = latest(values.where("number IS NOT NULL"), ["jurisdiction", "dimension"], "year", "id", 1998).select("jurisdiction", "dimension", F.col("number").alias("latest_number"), F.col("year").alias("number_year"))
    return any_kind.join(known, ["jurisdiction", "dimension"], "left").select("jurisdiction", "dimension", "year", "number", "latest_number", "number_year")


def _latest_sql(where: str = "") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction, dimension ORDER BY year DESC, id) AS n FROM ({VALUES}) WHERE year <= 1998 {where}) WHERE n = 1"


LATEST_SQL = f"""
SELECT a.jurisdiction, a.dimension, a.year, a.number, k.number AS latest_number, k.year AS number_year
FROM ({_latest_sql()}) a LEFT JOIN ({_latest_sql('AND number IS NOT NULL')}) k ON a.jurisdiction = k.jurisdiction AND a.dimension = k.dimension
"""


def policy_compare_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every jurisdiction's value of every dimension against that of jurisdiction 0."""
    now = latest(_values(spark, sf_dir), ["jurisdiction", "dimension"], "year", "id")
    codes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("jurisdiction"), "n_name")
    dims = now.select("dimension").distinct()
    grid = codes.crossJoin(F.broadcast(dims))  # a cell for each jurisdiction and dimension of the matrix
    base = now.where("jurisdiction = 0").select("dimension", F.col("number").alias("base"))
    cells = grid.join(now.select("jurisdiction", "dimension", "number", "year"), ["jurisdiction", "dimension"], "left").join(F.broadcast(base), "dimension", "left")
    note = F.when(F.col("number").isNull(), "silent").when(F.col("base").isNull(), "no baseline").when(F.col("number") == F.col("base"), "aligned").otherwise("differs")
    shown = F.when(F.col("number").isNotNull(), F.format_string("%.2f", "number")).otherwise("—")
    return cells.select("jurisdiction", "n_name", "dimension", "year", shown.alias("shown"), half_up(F.col("number") - F.col("base"), 4).alias("delta"), note.alias("note"))


COMPARE_SQL = f"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction, dimension ORDER BY year DESC, id) AS n FROM ({VALUES})) WHERE n = 1),
g AS (SELECT n_nationkey AS jurisdiction, n_name, dimension FROM nation, (SELECT DISTINCT dimension FROM l))
SELECT g.jurisdiction, n_name, g.dimension, l.year, coalesce(printf('%.2f', l.number), '—') AS shown, floor((l.number - b.number) * 10000 + 0.5) / 10000 AS delta,
  CASE WHEN l.number IS NULL THEN 'silent' WHEN b.number IS NULL THEN 'no baseline' WHEN l.number = b.number THEN 'aligned' ELSE 'differs' END AS note
FROM g LEFT JOIN l ON l.jurisdiction = g.jurisdiction AND l.dimension = g.dimension LEFT JOIN l b ON b.jurisdiction = 0 AND b.dimension = g.dimension
"""

# Fixed values of the sample rubric: weight of each dimension and whether more is better.
RUBRIC = {"1-URGENT": (3, True), "2-HIGH": (2, False), "3-MEDIUM": (2, True), "4-NOT SPECIFIED": (1, False), "5-LOW": (1, True)}


def policy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of the dimensions' min-max scores, coverage, grade and rank of every jurisdiction."""
    now = latest(_values(spark, sf_dir), ["jurisdiction", "dimension"], "year", "id").where("number IS NOT NULL")
    weight, better = F.lit(0), F.lit(False)
    for name, (w, up) in RUBRIC.items():
        weight, better = F.when(F.col("dimension") == name, F.lit(w)).otherwise(weight), F.when(F.col("dimension") == name, F.lit(up)).otherwise(better)
    dim = W.partitionBy("dimension")  # a row for each jurisdiction
    rows = now.withColumns({"low": F.min("number").over(dim), "high": F.max("number").over(dim), "weight": weight, "better": better})
    norm = (F.col("number") - F.col("low")) / (F.col("high") - F.col("low"))
    sub = F.when(F.col("high") == F.col("low"), F.lit(0.5)).when(F.col("better"), norm).otherwise(1 - norm)
    sums = rows.groupBy("jurisdiction").agg(half_up(F.sum(sub * F.col("weight")) / F.sum("weight") * 100, 1).alias("score"), half_up(F.sum("weight") / F.lit(float(sum(w for w, _ in RUBRIC.values()))), 2).alias("coverage"))
    grade = F.when(F.col("score") >= 80, "A").when(F.col("score") >= 65, "B").when(F.col("score") >= 50, "C").when(F.col("score") >= 35, "D").otherwise("F")
    return sums.withColumn("grade", grade).withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "jurisdiction")))


def _case(place: int) -> str:
    value = lambda v: str(v).upper() if isinstance(v, bool) else str(v)
    return "CASE dimension " + " ".join(f"WHEN '{k}' THEN {value(v[place])}" for k, v in RUBRIC.items()) + " END"


SCORE_SQL = f"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction, dimension ORDER BY year DESC, id) AS n FROM ({VALUES})) WHERE n = 1 AND number IS NOT NULL),
s AS (SELECT jurisdiction, {_case(0)} AS weight, CASE WHEN hi = lo THEN 0.5::DOUBLE WHEN {_case(1)} THEN (number - lo) / (hi - lo) ELSE 1 - (number - lo) / (hi - lo) END AS sub
  FROM (SELECT *, min(number) OVER (PARTITION BY dimension) AS lo, max(number) OVER (PARTITION BY dimension) AS hi FROM l)),
t AS (SELECT jurisdiction, floor(sum(sub * weight) / sum(weight) * 100 * 10 + 0.5) / 10 AS score, floor(sum(weight) / 9.0::DOUBLE * 100 + 0.5) / 100 AS coverage FROM s GROUP BY 1)
SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade, CAST(row_number() OVER (ORDER BY score DESC, jurisdiction) AS INT) AS rank FROM t
"""


def choropleth_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest known number of each jurisdiction for each dimension, and the dimension's range."""
    known = _values(spark, sf_dir).where("number IS NOT NULL").groupBy("dimension", "jurisdiction").agg(F.max_by("number", F.struct("year", -F.col("id"))).alias("number"))
    dim = W.partitionBy("dimension")
    return known.withColumns({"low": F.min("number").over(dim), "high": F.max("number").over(dim)})


CHORO_SQL = f"""
SELECT *, min(number) OVER (PARTITION BY dimension) AS low, max(number) OVER (PARTITION BY dimension) AS high FROM (
  SELECT dimension, jurisdiction, arg_max(number, (year, -id)) AS number FROM ({VALUES}) WHERE number IS NOT NULL GROUP BY 1, 2)
"""


def bundle_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity by nation from three sources, later ones over earlier ones, with the share of the total."""
    key = lambda c: F.col(c).alias("nation")
    fallback = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(key("n_nationkey"), (F.col("n_nationkey") * 10.0).alias("installed"), F.lit(100.0).alias("potential"))
    primary = table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").groupBy(key("s_nationkey")).agg(half_up(F.sum("s_acctbal"), 2).alias("installed"), F.lit(None).cast("double").alias("potential"))
    potential = table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").groupBy(key("c_nationkey")).agg(F.lit(None).cast("double").alias("installed"), half_up(F.sum("c_acctbal"), 2).alias("potential"))
    merged = overlay(overlay(fallback, primary, "nation", ["installed", "potential"]), potential, "nation", ["installed", "potential"])
    return merged.select("nation", "installed", "potential", half_up(F.try_divide(F.col("installed") * 100, F.col("potential")), 2).alias("realised"))


OVERLAY_SQL = """
WITH f AS (SELECT n_nationkey AS nation, n_nationkey * 10.0::DOUBLE AS installed, 100.0::DOUBLE AS potential FROM nation WHERE n_nationkey % 2 = 0),
p AS (SELECT s_nationkey AS nation, floor(sum(s_acctbal) * 100 + 0.5) / 100 AS installed FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1),
q AS (SELECT c_nationkey AS nation, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS potential FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1),
m AS (SELECT coalesce(f.nation, p.nation, q.nation) AS nation, coalesce(p.installed, f.installed) AS installed, coalesce(q.potential, f.potential) AS potential
  FROM f FULL JOIN p ON f.nation = p.nation FULL JOIN q ON coalesce(f.nation, p.nation) = q.nation)
SELECT *, floor(CASE WHEN potential <> 0 THEN installed * 100 / potential END * 100 + 0.5) / 100 AS realised FROM m
"""


def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items by headline, the first source in priority order kept; keys stay hashed, so no text is shuffled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.lower(F.trim("text")).cast("binary")).alias("headline"), "n_chars")
    priority = F.array_position(F.array(*[F.lit(f"src{i}") for i in (3, 1, 4, 15, 9, 2, 6)]), F.col("source"))
    ranked = rows.withColumn("priority", F.when(priority > 0, priority).otherwise(99).cast("int"))
    return keep_first(ranked, ["headline"], ["priority", "doc_id"]).select("doc_id", "source", "priority", "n_chars")


FIRST_SQL = """
SELECT doc_id, source, priority, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY priority, doc_id) AS n FROM (
    SELECT *, CAST(CASE WHEN source IN ('src3', 'src1', 'src4', 'src15', 'src9', 'src2', 'src6') THEN list_position(['src3', 'src1', 'src4', 'src15', 'src9', 'src2', 'src6'], source) ELSE 99 END AS INT) AS priority FROM documents)) WHERE n = 1
"""


def audit_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is missing, and customers without orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lost = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.lit("orders without customer").alias("audit"), F.count("*").alias("n"))
    idle = customers.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.lit("customers without order").alias("audit"), F.count("*").alias("n"))
    return lost.unionByName(idle)


ORPHAN_SQL = """
SELECT 'orders without customer' AS audit, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customers without order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
"""


def esz_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected areas (customers) without a notified zone (an urgent order), by market."""
    zones = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    left = table(spark, sf_dir, "customer").join(zones, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.groupBy("c_mktsegment").agg(F.count("*").alias("areas"), half_up(F.sum("c_acctbal"), 2).alias("balance"))


ESZ_SQL = "SELECT c_mktsegment, count(*) AS areas, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1"


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, area and share of the whole by nation and legal flag; totals are added up before the small joins."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_returnflag") == "R").alias("legal")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("area"))
    by = facts.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sums = by.groupBy("n_name", "legal").agg(F.sum("n").alias("features"), F.sum("area").alias("area"))
    return sums.withColumn("percent", half_up(F.col("area") * 100 / F.sum("area").over(W.partitionBy()), 3))  # over a row for each nation and flag


COVERAGE_SQL = """
SELECT *, floor(area * 100 / sum(area) OVER () * 1000 + 0.5) / 1000 AS percent FROM (
  SELECT n_name, l_returnflag = 'R' AS legal, count(*) AS features, sum(l_quantity) AS area FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
"""


def fiscal_year_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by fiscal year (from April), share, change on the year before, and rank."""
    year = F.when(F.month("o_orderdate") >= 4, F.year("o_orderdate")).otherwise(F.year("o_orderdate") - 1)
    sums = table(spark, sf_dir, "orders").groupBy(year.alias("fy")).agg(F.count("*").alias("n"), half_up(F.sum("o_totalprice"), 0).alias("total"))
    order = W.orderBy("fy")  # a row for each year
    before = F.lag("total").over(order)
    label = F.concat(F.lit("FY"), F.col("fy"), F.lit("-"), F.lpad(F.pmod(F.col("fy") + 1, F.lit(100)).cast("string"), 2, "0"))
    return sums.select("fy", label.alias("label"), "n", "total", half_up(F.col("total") * 100 / F.sum("total").over(W.partitionBy()), 3).alias("share"), half_up((F.col("total") - before) * 100 / before, 3).alias("yoy"), F.row_number().over(W.orderBy(F.col("total").desc(), "fy")).alias("rank"))


FISCAL_SQL = """
WITH s AS (SELECT CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 4 THEN 0 ELSE 1 END AS INT) AS fy, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM orders GROUP BY 1)
SELECT fy, 'FY' || fy || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS label, n, total, floor(total * 100 / sum(total) OVER () * 1000 + 0.5) / 1000 AS share,
  floor((total - lag(total) OVER (ORDER BY fy)) * 100 / lag(total) OVER (ORDER BY fy) * 1000 + 0.5) / 1000 AS yoy, CAST(row_number() OVER (ORDER BY total DESC, fy) AS INT) AS rank FROM s
"""


def rollup_cube_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and quantities by flag and status, with subtotals and the total."""
    out = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().cast("long").alias("level"))
    return out.orderBy("level", "l_returnflag", "l_linestatus")


ROLLUP_SQL = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"

def saved_site_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best supplier of each nation by balance; none where the best is shared or there is nothing to compare.

    Only the top value, its holder and how many hold it are kept per nation.
    """
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("metric"), F.col("s_suppkey").alias("site"))
    tops = rows.groupBy("nation", "metric").agg(F.count("*").alias("holders"), F.min("site").alias("site"))
    best = tops.groupBy("nation").agg(F.sum("holders").alias("sites"), F.max(F.struct("metric", "holders", "site")).alias("t"))
    return best.select("nation", "sites", F.col("t.metric").alias("metric"), F.when((F.col("sites") >= 2) & (F.col("t.holders") == 1), F.col("t.site")).alias("winner"))


WINNER_SQL = """
WITH r AS (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 1000) AS BIGINT) AS metric, s_suppkey AS site FROM supplier),
m AS (SELECT *, max(metric) OVER (PARTITION BY nation) AS top, count(*) OVER (PARTITION BY nation) AS sites FROM r)
SELECT nation, sites, top AS metric, CASE WHEN sites >= 2 AND count(*) = 1 THEN min(site) END AS winner FROM m WHERE metric = top GROUP BY nation, sites, top
"""


def voltage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by voltage, with the share of each among those of its priority."""
    volts = F.element_at(F.array(*[F.lit(v) for v in (66, 132, 220, 400)]), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority", volts.alias("kv")).agg(F.count("*").alias("n"))
    return n.withColumn("share", half_up(F.col("n") / F.sum("n").over(W.partitionBy("o_orderpriority")), 5))


VOLTAGE_SQL = "SELECT *, floor(n / sum(n) OVER (PARTITION BY o_orderpriority) * 1e5::DOUBLE + 0.5) / 1e5::DOUBLE AS share FROM (SELECT o_orderpriority, [66, 132, 220, 400][CAST(o_orderkey % 4 + 1 AS INT)] AS kv, count(*) AS n FROM orders GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (latest_policy_asof, policy_compare_diff, policy_score, choropleth_range, bundle_overlay, keep_first_dedupe, audit_orphans, esz_anti_join, coverage_report, fiscal_year_yoy, rollup_cube_sets, saved_site_winner, voltage_histogram)}
SQL = {"latest_policy_asof": LATEST_SQL, "policy_compare_diff": COMPARE_SQL, "policy_score": SCORE_SQL, "choropleth_range": CHORO_SQL, "bundle_overlay": OVERLAY_SQL, "keep_first_dedupe": FIRST_SQL, "audit_orphans": ORPHAN_SQL, "esz_anti_join": ESZ_SQL, "coverage_report": COVERAGE_SQL, "fiscal_year_yoy": FISCAL_SQL, "rollup_cube_sets": ROLLUP_SQL, "saved_site_winner": WINNER_SQL, "voltage_histogram": VOLTAGE_SQL}
