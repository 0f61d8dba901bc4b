"""Seed tables, record checks, manifests and caches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions.numeric import half_up
from siteloom.operators.dedupe import keep_first
from siteloom.operators.staging import shared_dir
from siteloom.plans.tables import table
from siteloom.streaming import loads

# The policy dimensions (key, category, value type, unit, place in its category) and the order of the categories.
DIMENSIONS = [
    ("preferential_tariff", "pricing", "numeric", "₹/kWh", 10), ("tariff_mode", "pricing", "enum", None, 20),
    ("third_party_sale", "open_access", "boolean", None, 10), ("captive_use", "open_access", "boolean", None, 20), ("geoa_threshold_kw", "open_access", "numeric", "kW", 30),
    ("wheeling_charge", "charges", "numeric", "₹/kWh", 10), ("wheeling_concession", "charges", "numeric", "%", 20), ("css_applicable", "charges", "boolean", None, 30), ("css_concession", "charges", "numeric", "%", 40), ("additional_surcharge", "charges", "boolean", None, 50), ("transmission_loss", "charges", "numeric", "%", 60),
    ("banking_allowed", "banking", "boolean", None, 10), ("banking_period", "banking", "enum", None, 20), ("banking_charge", "banking", "numeric", "%", 30), ("banking_third_party", "banking", "boolean", None, 40),
    ("rpo_wind", "rpo", "numeric", "%", 10), ("rpo_total", "rpo", "numeric", "%", 20), ("must_run", "dispatch", "boolean", None, 10), ("repowering_incentive", "repowering", "text", None, 10),
    ("land_allotment", "land", "text", None, 10), ("gram_panchayat_noc", "land", "boolean", None, 20), ("electricity_duty_exemption", "incentives", "text", None, 10), ("green_energy_cess", "incentives", "numeric", "₹/kWh", 20), ("single_window", "clearances", "boolean", None, 10),
]
CATEGORIES = ["pricing", "open_access", "charges", "banking", "rpo", "dispatch", "repowering", "land", "incentives", "clearances"]
ENUMS = {"tariff_mode": ["APPC", "preferential", "competitive_bidding", "project_specific"], "banking_period": ["none", "monthly", "annual", "seasonal"]}
# The jurisdictions (code, name).
JURISDICTIONS = [
    (None, "India (National)"), ("TN", "Tamil Nadu"), ("GJ", "Gujarat"), ("KA", "Karnataka"), ("RJ", "Rajasthan"), ("MH", "Maharashtra"), ("KL", "Kerala"), ("AP", "Andhra Pradesh"), ("MP", "Madhya Pradesh"),
]
CONFIDENCE = ["verified", "extracted", "estimated"]


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIMENSIONS, "key string, category string, value_type string, unit string, sort_order int")


def jurisdictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JURISDICTIONS, "code string, name string")


def values_sql(rows: list[tuple], columns: str) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def policy_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions in the order of their categories and jurisdictions with the national one first, each with how many orders stand for its values."""
    key, code = F.pmod("o_orderkey", F.lit(len(DIMENSIONS))).cast("int"), F.pmod("o_custkey", F.lit(len(JURISDICTIONS))).cast("int")
    counts = table(spark, sf_dir, "orders").groupBy(key.alias("d"), code.alias("j")).agg(F.count("*").alias("n"))  # a row for each pair
    named = lambda rows, at: F.element_at(F.array(*[F.lit(r[at]) for r in rows]), F.col("d" if rows is DIMENSIONS else "j") + 1)
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    rows = counts.groupBy(named(DIMENSIONS, 0).alias("key")).agg(F.sum("n").alias("n"))
    dims = dimensions(spark).join(rows, "key", "left").select(F.lit("dimension").alias("kind"), F.col("key").alias("code"), F.concat_ws(" ", "category", "value_type", "unit").alias("name"), F.row_number().over(W.orderBy(place, "sort_order")).alias("place"), F.coalesce("n", F.lit(0)).alias("n"))
    of = counts.groupBy(F.coalesce(named(JURISDICTIONS, 0), F.lit("national")).alias("code")).agg(F.sum("n").alias("n"))
    where = jurisdictions(spark).select(F.coalesce("code", F.lit("national")).alias("code"), "name", F.row_number().over(W.orderBy(F.col("code").isNotNull(), "name")).alias("place"))
    return dims.unionByName(where.join(of, "code", "left").select(F.lit("jurisdiction").alias("kind"), "code", "name", "place", F.coalesce("n", F.lit(0)).alias("n")))


META_SQL = f"""
WITH d AS ({values_sql(DIMENSIONS, 'key, category, value_type, unit, sort_order')}), j AS ({values_sql(JURISDICTIONS, 'code, name')}),
n AS (SELECT {[d[0] for d in DIMENSIONS]!r}[CAST(o_orderkey % {len(DIMENSIONS)} + 1 AS INT)] AS key, coalesce({[j[0] or 'national' for j in JURISDICTIONS]!r}[CAST(o_custkey % {len(JURISDICTIONS)} + 1 AS INT)], '') AS code FROM orders)
SELECT 'dimension' AS kind, key AS code, concat_ws(' ', category, value_type, unit) AS name, CAST(row_number() OVER (ORDER BY list_position({CATEGORIES!r}, category), sort_order) AS INT) AS place, (SELECT count(*) FROM n WHERE n.key = d.key) AS n FROM d
UNION ALL SELECT 'jurisdiction', coalesce(code, 'national'), name, CAST(row_number() OVER (ORDER BY code IS NOT NULL, name) AS INT), (SELECT count(*) FROM n WHERE n.code = coalesce(j.code, 'national')) FROM j
"""


def first_error(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that is broken, null if none is."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in rules])


def policy_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample policy records by the first rule they break; as a load takes all or nothing, whether each jurisdiction may be loaded.

    A record names its source and excerpt, has a whole year and a known
    confidence, and holds exactly one value, of its dimension's kind; a numeric
    dimension may hold text if its basis is a rule.
    """
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.pmod("o_custkey", F.lit(9)).cast("int").alias("jurisdiction"), pick([d[0] for d in DIMENSIONS] + [""], k * 3).alias("key"),
        pick(["p. 4", " ", "see note"], F.floor(k / 7)).alias("excerpt"), F.when(k % 41 != 0, "http://a.example").alias("url"), F.when(k % 37 == 0, F.lit(2020.5)).otherwise(F.year("o_orderdate").cast("double")).alias("year"),
        pick([*CONFIDENCE, "guessed"], F.floor(k / 11)).alias("confidence"), pick(["numeric", "boolean", "enum", "text", "rule", "two", "none"], F.floor(k / 3)).alias("given"), pick(["APPC", "monthly", "odd"], F.floor(k / 5)).alias("value"),
    )
    known = rows.join(F.broadcast(dimensions(spark)), "key", "left")
    given, kind = F.when(F.col("given") == "rule", "text").otherwise(F.col("given")), F.col("value_type")
    ruled, options = (F.col("given") == "rule"), reduce(lambda out, e: F.when(F.col("key") == e[0], F.array(*[F.lit(v) for v in e[1]])).otherwise(out), ENUMS.items(), F.lit(None).cast("array<string>"))
    deviates = (kind == "numeric") & (given == "text")
    error = first_error([
        (kind.isNull(), "unknown dimension"), (F.trim("excerpt") == "", "no excerpt"), (F.col("url").isNull(), "no source"), (F.col("year") != F.floor("year"), "year not whole"), (~F.col("confidence").isin(CONFIDENCE), "bad confidence"),
        (given.isin("two", "none"), "not one value"), (deviates & ~ruled, "text needs a rule"), (ruled & ~deviates, "rule out of place"), (~deviates & (given != kind), "wrong type"), ((kind == "enum") & ~F.array_contains(options, F.col("value")), "not in enum"),
    ])
    by = known.withColumn("error", error).groupBy("jurisdiction", "error").agg(F.count("*").alias("n"))
    return by.withColumn("loadable", F.sum(F.when(F.col("error").isNotNull(), F.col("n")).otherwise(0)).over(W.partitionBy("jurisdiction")) == 0)


RECORD_SQL = f"""
WITH r AS (SELECT CAST(o_custkey % 9 AS INT) AS jurisdiction, {[d[0] for d in DIMENSIONS] + ['']!r}[CAST(o_orderkey * 3 % {len(DIMENSIONS) + 1} + 1 AS INT)] AS key, ['p. 4', ' ', 'see note'][CAST(o_orderkey // 7 % 3 + 1 AS INT)] AS excerpt, o_orderkey % 41 = 0 AS no_url, o_orderkey % 37 = 0 AS bad_year,
  {[*CONFIDENCE, 'guessed']!r}[CAST(o_orderkey // 11 % 4 + 1 AS INT)] AS confidence, ['numeric', 'boolean', 'enum', 'text', 'rule', 'two', 'none'][CAST(o_orderkey // 3 % 7 + 1 AS INT)] AS given, ['APPC', 'monthly', 'odd'][CAST(o_orderkey // 5 % 3 + 1 AS INT)] AS value FROM orders),
k AS (SELECT r.*, value_type AS kind, CASE given WHEN 'rule' THEN 'text' ELSE given END AS g FROM r LEFT JOIN ({values_sql(DIMENSIONS, 'key, category, value_type, unit, sort_order')}) d ON d.key = r.key),
e AS (SELECT jurisdiction, CASE WHEN kind IS NULL THEN 'unknown dimension' WHEN trim(excerpt) = '' THEN 'no excerpt' WHEN no_url THEN 'no source' WHEN bad_year THEN 'year not whole' WHEN confidence = 'guessed' THEN 'bad confidence' WHEN g IN ('two', 'none') THEN 'not one value'
  WHEN kind = 'numeric' AND g = 'text' THEN CASE WHEN given <> 'rule' THEN 'text needs a rule' END WHEN given = 'rule' THEN 'rule out of place' WHEN g <> kind THEN 'wrong type'
  WHEN kind = 'enum' AND NOT list_contains(CASE key WHEN 'tariff_mode' THEN {ENUMS['tariff_mode']!r} ELSE {ENUMS['banking_period']!r} END, value) THEN 'not in enum' END AS error FROM k)
SELECT *, sum(CASE WHEN error IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY jurisdiction) = 0 AS loadable FROM (SELECT jurisdiction, error, count(*) AS n FROM e GROUP BY ALL)
"""


def district_feature_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample district features by the first rule they break: names, finite capacity of at least 0, whole turbines, polygons."""
    k = F.col("p_partkey")
    mw = F.when(k % 17 == 0, F.lit(float("nan"))).when(k % 19 == 0, F.lit(-1.0)).otherwise(F.col("p_size").cast("double"))
    weg, shape = F.when(k % 23 == 0, F.lit(1.5)).otherwise(F.col("p_size").cast("double")), F.when(k % 5 == 0, "MultiPolygon").when(k % 29 == 0, "Point").otherwise("Polygon")
    rows = table(spark, sf_dir, "part").select(F.when(k % 13 != 0, F.col("p_brand")).alias("district"), F.col("p_type").alias("name"), mw.alias("mw"), weg.alias("weg"), shape.alias("shape"), "p_brand")
    finite = ~F.isnan("mw") & (F.abs("mw") < F.lit(float("inf")))
    error = first_error([(F.col("district").isNull() | (F.col("name") == ""), "no name"), (~finite | (F.col("mw") < 0), "bad capacity"), ((F.col("weg") != F.floor("weg")) | (F.col("weg") < 0), "bad turbines"), (~F.col("shape").isin("Polygon", "MultiPolygon"), "not a polygon")])
    return rows.withColumn("error", error).groupBy("p_brand", "error").agg(F.count("*").alias("n"), half_up(F.sum(F.when(F.col("error").isNull(), F.col("mw"))), 1).alias("mw"))


DISTRICT_SQL = """
SELECT p_brand, error, count(*) AS n, floor(sum(CASE WHEN error IS NULL THEN p_size END) * 10 + 0.5) / 10 AS mw FROM (
  SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'no name' WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 THEN 'bad capacity' WHEN p_partkey % 23 = 0 THEN 'bad turbines' WHEN p_partkey % 29 = 0 AND p_partkey % 5 <> 0 THEN 'not a polygon' END AS error FROM part) GROUP BY ALL
"""

# The most a plan may ask for (rates a kilometre, kilometres a day, escorts, states, loads, shipments, megawatts), and a saved site's name and ring.
BOUNDS = [("rate", 0.0, 10000.0), ("km_per_day", 0.001, 2000.0), ("escorts", 0.0, 20.0), ("states", 0.0, 30.0), ("loads", 0.001, 50.0), ("shipments", 1.0, 20.0), ("rated_mw", 0.001, 100.0), ("name_length", 1.0, 80.0), ("vertices", 4.0, 4000.0)]


def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the first of their figures that is out of its bounds."""
    k = F.col("l_orderkey") * 4 + F.col("l_linenumber")
    figures = [F.pmod(k * (7 + 2 * i), F.lit(int(high * 1.05) + 2)).cast("double") for i, (_, _, high) in enumerate(BOUNDS)]
    error = first_error([((v < low) | (v > high), name) for v, (name, low, high) in zip(figures, BOUNDS, strict=True)])
    return table(spark, sf_dir, "lineitem").groupBy(error.alias("error")).agg(F.count("*").alias("n"))


BOUNDS_SQL = "SELECT CASE " + " ".join(f"WHEN (l_orderkey * 4 + l_linenumber) * {7 + 2 * i} % {int(high * 1.05) + 2} < {low} OR (l_orderkey * 4 + l_linenumber) * {7 + 2 * i} % {int(high * 1.05) + 2} > {high} THEN '{name}'" for i, (name, low, high) in enumerate(BOUNDS)) + " END AS error, count(*) AS n FROM lineitem GROUP BY 1"


def license_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a licence manifest, a source each, in the order of tier and id; and the uploads that may not be registered.

    A manual upload needs a layer, a known class, and notes of 8 characters or more.
    """
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src_"), k).alias("id"), F.pmod(k, F.lit(4)).cast("int").alias("tier"), (k % 3 == 0).alias("legal"), F.when(k % 2 == 0, "CC0").otherwise("ODbL").alias("license"), F.when(k % 5 != 0, F.col("s_name")).alias("authority"),
        F.when(k % 4 != 0, F.lit("2024-03-05")).alias("acquired"), F.when(k % 7 == 0, "a | b").when(k % 7 == 1, "from the state gazette").when(k % 7 == 2, "short").alias("notes"), F.when(k % 6 == 0, "blue").otherwise("red").alias("class"), F.when(k % 11 != 0, "layer").alias("layer"))
    dash = lambda c: F.coalesce(c, F.lit("—"))
    line = F.concat(F.lit("| `"), "id", F.lit("` | "), "tier", F.lit(" | "), F.when(F.col("legal"), "✅").otherwise("—"), F.lit(" | "), "license", F.lit(" | "), dash(F.col("authority")), F.lit(" | "), dash(F.col("acquired")), F.lit(" | "), F.replace(F.coalesce("notes", F.lit("")), F.lit("|"), F.lit(r"\|")), F.lit(" |"))
    gate = first_error([(F.col("layer").isNull(), "no layer"), (~F.col("class").isin("red", "amber"), "bad class"), (F.coalesce(F.length(F.trim("notes")), F.lit(0)) < 8, "notes too short")])
    return rows.select("tier", "id", line.alias("line"), gate.alias("upload_error")).orderBy("tier", "id")


MANIFEST_SQL = r"""
WITH s AS (SELECT s_suppkey AS k, 'src_' || s_suppkey AS id, CAST(s_suppkey % 4 AS INT) AS tier, CASE s_suppkey % 7 WHEN 0 THEN 'a | b' WHEN 1 THEN 'from the state gazette' WHEN 2 THEN 'short' END AS notes, s_name FROM supplier)
SELECT tier, id, '| `' || id || '` | ' || tier || ' | ' || CASE WHEN k % 3 = 0 THEN '✅' ELSE '—' END || ' | ' || CASE WHEN k % 2 = 0 THEN 'CC0' ELSE 'ODbL' END || ' | ' || CASE WHEN k % 5 <> 0 THEN s_name ELSE '—' END || ' | ' || CASE WHEN k % 4 <> 0 THEN '2024-03-05' ELSE '—' END
  || ' | ' || replace(coalesce(notes, ''), '|', '\|') || ' |' AS line, CASE WHEN k % 11 = 0 THEN 'no layer' WHEN k % 6 = 0 THEN 'bad class' WHEN coalesce(length(notes), 0) < 8 THEN 'notes too short' END AS upload_error FROM s
"""


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of turbines brings by maker: rows, known ratings and dates, megawatts, and rows that stand for one already there."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_brand", F.floor(k / 3).alias("osm_id"), F.when(k % 4 != 0, F.col("p_size") * 100.0).alias("kw"), F.when(k % 5 != 0, F.col("p_type")).alias("start"))
    found = rows.groupBy("p_brand", "osm_id").agg(F.count("*").alias("n"), F.count("kw").alias("rated"), F.count("start").alias("dated"), F.sum("kw").alias("kw"))
    return found.groupBy("p_brand").agg(F.sum("n").alias("n"), F.sum("rated").alias("rated"), F.sum("dated").alias("dated"), half_up(F.sum("kw") / 1000, 1).alias("mw"), F.sum(F.col("n") - 1).alias("repeated"))


INGEST_SQL = """
SELECT p_brand, count(*) AS n, count(kw) AS rated, count(start) AS dated, floor(sum(kw) / 1000 * 10 + 0.5) / 10 AS mw, count(*) - count(DISTINCT osm_id) AS repeated FROM (
  SELECT p_brand, p_partkey // 3 AS osm_id, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 100.0::DOUBLE END AS kw, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS start FROM part) GROUP BY 1
"""

TTL_HOURS, SIDE = 48, 256  # tiles of zoom 8


def tile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache answers for each tile asked for: its newest entry while fresh, a stale one where fetching failed, else a fetch; and the tiles still to seed."""
    k = F.col("event_id")
    tile = F.concat_ws("/", F.lit("8"), F.pmod(k * 3, F.lit(SIDE)).cast("int"), F.pmod(F.floor(k / 5), F.lit(SIDE)).cast("int"))
    age = F.pmod(k * 13, F.lit(200))
    kept = table(spark, sf_dir, "events").groupBy(tile.alias("tile")).agg(F.min(age).alias("age"))
    cover = spark.range(SIDE).select(F.col("id").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).select(F.concat_ws("/", F.lit("8"), F.col("x").cast("int"), "y").alias("tile"), (F.pmod(F.col("x") + F.col("y"), F.lit(10)) == 0).alias("down"))
    state = F.when(F.col("age") < TTL_HOURS, "hit").when(F.col("age").isNotNull() & F.col("down"), "stale").when(F.col("down"), "unavailable").otherwise("fetch")
    return cover.join(kept, "tile", "left").groupBy(state.alias("state")).agg(F.count("*").alias("tiles"), F.count(F.when(F.col("age").isNull(), 1)).alias("to_seed"), F.max("age").alias("oldest"))


CACHE_SQL = f"""
WITH k AS (SELECT '8/' || (event_id * 3 % {SIDE}) || '/' || (event_id // 5 % {SIDE}) AS tile, min(event_id * 13 % 200) AS age FROM events GROUP BY 1),
c AS (SELECT '8/' || x || '/' || y AS tile, (x + y) % 10 = 0 AS down FROM range({SIDE}) AS a(x), range({SIDE}) AS b(y))
SELECT CASE WHEN age < {TTL_HOURS} THEN 'hit' WHEN age IS NOT NULL AND down THEN 'stale' WHEN down THEN 'unavailable' ELSE 'fetch' END AS state, count(*) AS tiles, count(*) - count(age) AS to_seed, max(age) AS oldest FROM c LEFT JOIN k USING (tile) GROUP BY 1
"""

QUERIES = {f.__name__: f for f in (policy_meta, policy_record_errors, district_feature_errors, request_bounds, license_manifest, ingest_summary, tile_cache)}
SQL = {"policy_meta": META_SQL, "policy_record_errors": RECORD_SQL, "district_feature_errors": DISTRICT_SQL, "request_bounds": BOUNDS_SQL, "license_manifest": MANIFEST_SQL, "ingest_summary": INGEST_SQL, "tile_cache": CACHE_SQL}


def incremental_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event, loaded as a stream: the files that are there now go into the table batch by batch, changes of a key once."""
    events = table(spark, sf_dir, "events")
    at = f"{shared_dir(spark)}/siteloom/load-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    changes = stream.select("user_id", "ts", "event_id", "event_type")
    loads.load(changes, f"{at}/table", f"{at}/checkpoint", ["user_id"], ["ts", "event_id"]).awaitTermination()
    # Batches hold the newest of their own files; of several batches the newest counts, not the last.
    return keep_first(spark.read.parquet(f"{at}/table/batch-*"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


INCREMENTAL_SQL = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
QUERIES["incremental_latest"] = incremental_latest
SQL["incremental_latest"] = INCREMENTAL_SQL
