"""Labels, formats, links and place names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import labels
from siteloom.functions.geo import sql_lat, sql_lon, synthetic_lat, synthetic_lon
from siteloom.operators.ranking import if_small
from siteloom.plans.tables import table

# What the sample mast labels append to, or put before, a place name.
AFTER = ["150m Jul24-Jun25_Pvt. Mast", "-V_Pvt. WM_65m", " CECL_65m_WM_June2010-May2013", "", "_79.5 m", " 12 m Mast", " 2may2011 data", " Wind 500m"]
BEFORE = ["", "", "", "_Pvt. WM-", "Mast-", "", "Pvt. WM- ", ""]


def mast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place name, height and height class of masts from their free-form labels."""
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    label = F.concat(pick(BEFORE, k), F.initcap(F.concat(F.lit("place"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))), pick(AFTER, F.floor(k / 8)))
    rows = table(spark, sf_dir, "customer").select(k.alias("mast"), label.alias("label")).withColumn("height", labels.height_m(F.col("label")))
    return rows.select("mast", labels.display_name(F.col("label")).alias("name"), "height", labels.height_class(F.col("height")).alias("class"))


def _sql_text(pattern: str) -> str:
    """A pattern in SQL, whose engine can't look ahead: the digits after a height's mark are read instead."""
    return pattern.replace(r"(?=\d)", r"\d+").replace("'", "''")


def _tidy_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[\"''*]', '', 'g'), '\\s+', ' ', 'g'), '^{labels.EDGE}+|{labels.EDGE}+$', '', 'g')"


def _labels_sql() -> str:
    place = "'Place' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"
    edges = rf"'^{labels.EDGE}+|{labels.EDGE}+$', '', 'g'"
    return f"""
WITH l AS (SELECT c_custkey AS mast, {BEFORE!r}[CAST(c_custkey % 8 + 1 AS INT)] || {place} || {AFTER!r}[CAST(c_custkey // 8 % 8 + 1 AS INT)] AS label FROM customer),
a AS (SELECT *, replace(label, '_', ' ') AS line, coalesce(nullif(regexp_extract(label, '(?i)([0-9]{{2,3}})\\s*m\\b', 1), ''), nullif(regexp_extract(label, '(?i)([0-9]{{2,3}})m', 1), '')) AS digits FROM l),
b AS (SELECT *, CASE WHEN regexp_matches(line, '{_sql_text(labels.BEFORE_MARKER)}') THEN regexp_extract(line, '{_sql_text(labels.BEFORE_MARKER)}', 1) ELSE line END AS start,
  regexp_replace(regexp_replace(regexp_replace(line, {edges}), '{_sql_text(labels.TAIL)}', ''), {edges}) AS peeled FROM a),
c AS (SELECT *, {_tidy_sql('start')} AS head, {_tidy_sql(f"regexp_replace(peeled, '{_sql_text(labels.HEAD)}', '')")} AS rest, {_tidy_sql('peeled')} AS tail, {_tidy_sql('line')} AS whole, CASE WHEN CAST(digits AS INT) BETWEEN 10 AND 200 THEN CAST(digits AS INT) END AS height FROM b)
SELECT mast, CASE WHEN head <> '' THEN head WHEN regexp_matches(peeled, '{_sql_text(labels.OPENS_STRONG)}') AND length(rest) >= 3 THEN rest WHEN tail <> '' AND tail <> whole THEN tail WHEN whole <> '' THEN whole ELSE trim(label) END AS name,
  height, CAST(CASE WHEN height IS NULL OR height <= 0 THEN -1 WHEN height < 50 THEN 0 WHEN height <= 100 THEN 1 ELSE 2 END AS INT) AS class FROM c
"""


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, distances, shares, places and days as a report shows them."""
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    scale = F.element_at(F.array(*[F.lit(v) for v in (0.01, 1.0, 37.0, 1900.0)]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    share = F.when(k % 5 != 0, (F.pmod(k * 7, F.lit(999)) + F.lit(0.3)) / F.lit(99900.0))
    lon, lat = synthetic_lon(k) - 80, synthetic_lat(k) - 20
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.concat(F.lit("31/13/"), F.year("o_orderdate")))
    return table(spark, sf_dir, "orders").select(
        k.alias("item"), labels.rupees(x * scale + 0.25).alias("rupees"), labels.rupees_short(x * scale + 0.00137).alias("short"), labels.kilometres(x * scale / 100 + 0.25).alias("km"), labels.percent(share).alias("percent"),
        labels.area_percent(share).alias("area"), labels.coordinates(lon, lat).alias("place"), labels.with_unit(x * scale + 0.00137, "kV").alias("kv"), labels.day_label(day).alias("day"),
    )


def _grouped_sql(x: str) -> str:
    digits = f"CAST(abs({x}) AS VARCHAR)"
    pairs = f"regexp_replace(reverse(regexp_replace(reverse({digits}[:-4]), '([0-9]{{2}})', '\\1,', 'g')), '^,', '')"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN length({digits}) <= 3 THEN {digits} ELSE {pairs} || ',' || right({digits}, 3) END)"


def _formats_sql() -> str:
    whole = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"
    return f"""
WITH o AS (SELECT o_orderkey AS k, o_totalprice * [0.01::DOUBLE, 1.0::DOUBLE, 37.0::DOUBLE, 1900.0::DOUBLE][CAST(o_orderkey % 4 + 1 AS INT)] AS x, CASE WHEN o_orderkey % 5 <> 0 THEN ((o_orderkey * 7 % 999) + 0.3::DOUBLE) / 99900.0::DOUBLE END AS share,
  {sql_lon('o_orderkey')} - 80 AS lon, {sql_lat('o_orderkey')} - 20 AS lat, o_orderdate AS d FROM orders)
SELECT k AS item, '₹' || {_grouped_sql(whole('x + 0.25'))} AS rupees,
  CASE WHEN abs(x + 0.00137) >= 1e7 THEN printf('₹%.2f Cr', (x + 0.00137) / 1e7) WHEN abs(x + 0.00137) >= 1e5 THEN printf('₹%.2f L', (x + 0.00137) / 1e5) ELSE '₹' || {_grouped_sql(whole('x + 0.00137'))} END AS short,
  {_grouped_sql(whole('x / 100 + 0.25'))} || ' km' AS km, CASE WHEN share IS NULL THEN '—' ELSE printf('%.1f%%', share * 100) END AS percent,
  CASE WHEN share * 100 <= 0 THEN '0%' WHEN share * 100 < 1 THEN printf('%.1f%%', share * 100) ELSE {whole('share * 100')} || '%' END AS area,
  printf('%.4f° ', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', ' || printf('%.4f° ', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS place,
  regexp_replace(printf('%.2f', x + 0.00137), '\\.?0+$', '') || ' kV' AS kv, CASE WHEN k % 3 = 2 THEN '31/13/' || year(d) ELSE day(d) || ' ' || strftime(d, '%b') || ' ' || year(d) END AS day
FROM o
"""


def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that hold a site's square, read back; a link of three corners gives no ring."""
    k = F.col("s_suppkey")
    lon, lat = synthetic_lon(k), synthetic_lat(k * 3)
    corners = [(0.0, 0.0), (0.05, 0.0), (0.05, 0.0412347), (0.0, 0.0412347)]
    ring = F.array(*[F.struct((lon + dx).alias("x"), (lat + dy).alias("y")) for dx, dy in corners])
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), labels.permalink(F.when(k % 4 == 0, F.slice(ring, 1, 3)).otherwise(ring)).alias("link"))
    back = labels.ring_of(F.concat(F.lit("#x=1&"), F.col("link")))
    again = labels.inflated(labels.deflated(F.col("link")))
    return rows.select("site", F.regexp_extract("link", "aoi=.(.*)$", 1).alias("payload"), F.coalesce(F.size(back), F.lit(-1)).alias("corners"), back[2]["y"].alias("north"), (again == F.col("link")).alias("same"))


PERMALINK_SQL = f"""
WITH s AS (SELECT s_suppkey AS site, {sql_lon('s_suppkey')} AS lon, {sql_lat('s_suppkey * 3')} AS lat FROM supplier),
t AS (SELECT *, lambda_n[1] AS x0, lambda_n[2] AS y0, lambda_n[3] AS x1, lambda_n[4] AS y1 FROM (
  SELECT *, list_transform([lon, lat, lon + 0.05::DOUBLE, lat + 0.0412347::DOUBLE], lambda v: regexp_replace(printf('%.6f', v), '\\.?0+$', '')) AS lambda_n FROM s)),
j AS (SELECT *, '[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || ']' || CASE WHEN site % 4 = 0 THEN ']' ELSE ',[' || x0 || ',' || y1 || ']]' END AS json FROM t)
SELECT site, rtrim(translate(base64(encode(json)), '+/', '-_'), '=') AS payload, CAST(CASE WHEN site % 4 = 0 THEN -1 ELSE 4 END AS INT) AS corners, CASE WHEN site % 4 <> 0 THEN CAST(y1 AS DOUBLE) END AS north, true AS same FROM j
"""


def place_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands under a place's name: its parts without blanks, its own name and repeats next to each other; and its bounds put in order."""
    k = F.col("c_custkey")
    city = F.when(k % 4 == 0, None).when(k % 4 == 1, F.col("n_name")).otherwise(F.concat(F.lit("City"), k % 50))
    name = F.when(k % 6 == 0, F.col("r_name")).when(k % 7 == 0, None).otherwise(F.concat(F.lit("City"), k % 51))
    rows = table(spark, sf_dir, "customer").join(if_small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(if_small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = rows.select(k.alias("place"), name.alias("name"), F.array(city, F.col("n_name"), F.col("r_name")).alias("parts"), F.array(synthetic_lon(k), synthetic_lat(k), synthetic_lon(k) + 1, synthetic_lat(k) - 1).alias("e")).where("name IS NOT NULL")
    kept = F.filter("parts", lambda v: v.isNotNull() & (v != F.col("name")))
    line = parts.withColumn("kept", kept).withColumn("line", F.filter("kept", lambda v, i: (i == 0) | (v != F.get(F.col("kept"), i - 1))))
    return line.select("place", F.array_join("line", ", ").alias("detail"), *(F.get("e", F.lit(i)).alias(n) for n, i in (("west", 0), ("south", 3), ("east", 2), ("north", 1))))


PLACE_SQL = f"""
WITH c AS (SELECT c_custkey AS place, CASE WHEN c_custkey % 6 = 0 THEN r_name WHEN c_custkey % 7 = 0 THEN NULL ELSE 'City' || (c_custkey % 51) END AS name,
  [CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN n_name ELSE 'City' || (c_custkey % 50) END, n_name, r_name] AS parts, {sql_lon('c_custkey')} AS lon, {sql_lat('c_custkey')} AS lat
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, list_filter(parts, lambda v: v IS NOT NULL AND v <> name) AS kept FROM c WHERE name IS NOT NULL)
SELECT place, coalesce(array_to_string(list_filter(kept, lambda v, i: i = 1 OR v <> kept[i - 1]), ', '), '') AS detail, lon AS west, lat - 1 AS south, lon + 1 AS east, lat AS north FROM k
"""

QUERIES = {f.__name__: f for f in (mast_labels, display_formats, permalinks, place_details)}
SQL = {"mast_labels": _labels_sql(), "display_formats": _formats_sql(), "permalinks": PERMALINK_SQL, "place_details": PLACE_SQL}
