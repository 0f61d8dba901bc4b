"""Text extraction, classification and rewriting queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions import text as tx
from siteloom.functions.numeric import half_up
from siteloom.operators.names import resolved
from siteloom.operators.proximity import clusters
from siteloom.functions.geo import sql_haversine, synthetic_lat, synthetic_lon
from siteloom.plans.spatial import MASTS
from siteloom.plans.tables import table


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum of each page's text."""
    rows = table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


STRIP_SQL = f"SELECT page_id, CAST(length(t) AS INT) AS chars, md5(t) AS md5 FROM (SELECT page_id, {tx.sql_strip_html('html')} AS t FROM pages)"


def html_row_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page's lists: how many, the first address, and the longest label."""
    links = F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)">[^<]*</a>'), F.lit(1))
    labels = F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))
    longest = F.aggregate(labels, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("links"), F.get(links, F.lit(0)).alias("first"), longest.alias("longest"), title.alias("title"))


ROWS_SQL = """
SELECT page_id, CAST(len(l) AS INT) AS links, l[1] AS first, coalesce(list_reduce(t, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END, ''), '') AS longest, title FROM (
  SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1) AS l, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
"""


def parse_power_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings and voltages parsed from text of mixed units, and a number from the events' JSON elsewhere."""
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in (" MW", "kW", " W", "", " GW")]), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    rating = F.concat(F.col("p_size").cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"), unit)
    volts = F.concat_ws(";", F.pmod(k * 11, F.lit(400)).cast("string"), F.when(k % 4 == 0, "abc"), F.pmod(k * 13, F.lit(300)).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", rating.alias("rating"), F.when(k % 6 != 0, volts).otherwise("none").alias("volts"))
    return rows.select("p_partkey", half_up(tx.rated_kw(F.col("rating")), 3).alias("kw"), tx.max_voltage(F.col("volts")).alias("volts"))


PARSE_SQL = """
WITH p AS (
  SELECT p_partkey, p_size || '.' || (p_partkey % 10) || [' MW', 'kW', ' W', '', ' GW'][CAST(p_partkey % 5 + 1 AS INT)] AS rating,
    CASE WHEN p_partkey % 6 <> 0 THEN concat_ws(';', CAST(p_partkey * 11 % 400 AS VARCHAR), CASE WHEN p_partkey % 4 = 0 THEN 'abc' END, CAST(p_partkey * 13 % 300 AS VARCHAR)) ELSE 'none' END AS volts FROM part
), u AS (SELECT *, CAST(regexp_extract(rating, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS v, lower(regexp_extract(rating, '[0-9.]+ *([A-Za-z]*)', 1)) AS unit FROM p)
SELECT p_partkey, floor(CASE unit WHEN 'gw' THEN v * 1e6 WHEN 'mw' THEN v * 1e3 WHEN 'kw' THEN v WHEN 'w' THEN v / 1e3 ELSE CASE WHEN v >= 10000 THEN v / 1e3 ELSE v END END * 1000 + 0.5) / 1000 AS kw,
  list_max(list_filter(list_transform(string_split(volts, ';'), lambda x: TRY_CAST(trim(x) AS DOUBLE)), lambda x: x > 0)) AS volts FROM u
"""


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from each event's JSON, summed by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("known"), F.sum(k).alias("total"), F.max(k).alias("most"))


PROPS_SQL = "SELECT event_type, count(k) AS known, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"

# Zone names that count as the strictest coastal class.
ZONES = ["CRZ - IA", "CRZ-II", "crz - i", "ITZ-IB", "No Development Zone", "CRZ-IVB", "Mangrove buffer", "crz-ib"]


def classify_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coastal class and forest layer of features named in different spellings."""
    k = F.col("p_partkey")
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.pmod(k, F.lit(len(ZONES))) + 1).cast("int"))
    plain = F.regexp_replace(F.lower(zone), " +", "")
    red = plain.rlike("^crz-i[ab]?$") | (plain == "itz-ib") | plain.contains("mangrove")
    cover = F.lower("p_name").contains("ring") | F.lower("p_type").contains("econ")
    return table(spark, sf_dir, "part").groupBy(F.when(red, "crz_1").otherwise("crz_other").alias("layer"), F.when(red, "red").otherwise("amber").alias("class"), F.when(cover, "forest_cover").otherwise("forest_legal").alias("forest"), (~cover).alias("legal")).agg(F.count("*").alias("n"))


CLASSIFY_SQL = f"""
SELECT CASE WHEN red THEN 'crz_1' ELSE 'crz_other' END AS layer, CASE WHEN red THEN 'red' ELSE 'amber' END AS class, CASE WHEN cover THEN 'forest_cover' ELSE 'forest_legal' END AS forest, NOT cover AS legal, count(*) AS n FROM (
  SELECT regexp_matches(z, '^crz-i[ab]?$') OR z = 'itz-ib' OR contains(z, 'mangrove') AS red, cover FROM (
    SELECT replace(lower({ZONES!r}[CAST(p_partkey % 8 + 1 AS INT)]), ' ', '') AS z, contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ') AS cover FROM part)) GROUP BY 1, 2, 3, 4
"""

# Endings that give the sample queries something to rewrite.
TAILS = [
    " in MP", " by gujrat masts", " WEG of TN", " Suzion in KA and rajstan", "", " how many makers does Vesta name in 2021", " GJ,MH;UP share of Siemens Gamesa", " installed capacity of westbengal turbines in FY 2024-25",
    " which company monitoring percent  ", " UPS Kaput WTGs orissa", " mast of SIVA Wind in HP HP",
]


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a query with shorthand, rewritten, expanded and given variants."""
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(TAILS))) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("q"))
    rows = rows.withColumn("stated", tx.with_states(F.col("q"))).withColumn("canonical", tx.mended(F.col("stated"))).withColumn("has", tx.mentions(F.col("canonical"))).withColumn("variants", tx.variants(F.col("canonical"), F.col("has")))
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select("conv_id", "turn", md5(F.col("canonical")).alias("canonical_md5"), md5(tx.expanded(F.col("canonical"))).alias("expanded_md5"), F.size("variants").alias("variants"), md5(F.array_join("variants", "|")).alias("variants_md5"), (F.col("q") != F.col("canonical")).alias("changed"))


def _rewrite_sql() -> str:
    state = lambda q, s: f"regexp_replace({q}, '(^|[^A-Za-z]){s[0]}($|[^A-Za-z])', '\\1{s[1]}\\2', 'g')"
    out = reduce(lambda q, s: state(state(q, s), s), tx.STATES.items(), "q")  # neighbours share the letter between them, so twice
    out = reduce(lambda q, t: f"regexp_replace({q}, '\\b{t[0]}\\b', '{t[1]}', 'gi')", tx.TYPOS.items(), out)
    more = ", ".join(f"CASE WHEN regexp_matches(c, '\\b{k}\\b') AND NOT contains(lower(c), '{v.lower()}') THEN '{v}' END" for k, v in tx.EXPANSIONS.items())
    has = {k: f"regexp_matches(c, '{v}')" for k, v in tx.MENTIONS.items()}
    when = {"maker and year": f"{has['maker']} AND {has['year']}", "maker and state": f"{has['maker']} AND {has['state']}", "maker alone": f"{has['maker']} AND NOT {has['year']} AND NOT {has['state']}", "mast": has["mast"], "share": has["share"], "how many makers": f"{has['how many']} AND {has['makers']}"}
    forms = ", ".join(f"CASE WHEN {when[k]} THEN '{lead}' || c END" for k, lead in tx.VARIANTS)
    keep = "lambda x: x IS NOT NULL"
    return f"""SELECT conv_id, turn, md5(c) AS canonical_md5, md5(CASE WHEN len(m) = 0 THEN c ELSE c || ' (' || array_to_string(m, '; ') || ')' END) AS expanded_md5, CAST(len(v) AS INT) AS variants, md5(coalesce(array_to_string(v, '|'), '')) AS variants_md5, q <> c AS changed FROM (
      SELECT *, list_filter([{more}], {keep}) AS m, list_filter([{forms}], {keep}) AS v FROM (
        SELECT conv_id, turn, q, regexp_replace({out}, '^\\s+|\\s+$', '', 'g') AS c FROM (SELECT conv_id, turn, coalesce(text, '') || {TAILS!r}[CAST((conv_id + turn) % {len(TAILS)} + 1 AS INT)] AS q FROM conversations)))"""


# Headlines of the sample news and tenders, to which a document's text is the summary.
HEADLINES = [
    "Offshore wind lease in Gujarat", "Offshore substation order", "Repowering of old sites in Tamil Nadu", "Solar park opens", "WTG maker Suzlon wins order", "पवन ऊर्जा", "JSW  Energy results", "Tender for 300 MW FDRE in Karnataka",
    "Wind-solar hybrid tender in Rajasthan", "RTC power tender", "Windfall tax", "Round-the-clock supply of 100 MW",
]


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]), (F.pmod(k, F.lit(len(HEADLINES))) + 1).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k * 7, F.lit(365)).cast("int"))
    return table(spark, sf_dir, "documents").select(k.alias("item"), title.alias("title"), F.coalesce("text", F.lit("")).alias("summary"), F.col("source"), day.alias("published"), F.concat(F.lit("u"), F.floor(k / 2)).alias("url"))


NEWS = f"SELECT doc_id AS item, {HEADLINES!r}[CAST(doc_id % {len(HEADLINES)} + 1 AS INT)] AS title, coalesce(text, '') AS summary, source, DATE '2024-01-01' + CAST(doc_id * 7 % 365 AS INT) AS published, 'u' || (doc_id // 2) AS url FROM documents"


def news_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by source: whether about wind, its class by title, whether in Hindi; and the same items as tenders."""
    title = F.col("title")
    relevant = F.concat_ws(" ", title, "summary").rlike("(?i)" + tx.ascii_words(tx.WIND))
    kept = title.rlike("(?i)" + tx.ascii_words(tx.TENDERS_KEPT))
    rows = _news(spark, sf_dir).select("source", relevant.alias("relevant"), tx.first_match(title, tx.RELEASES, "General").alias("release"), title.rlike("[ऀ-ॿ]").alias("hindi"), F.when(kept, tx.first_match(title, tx.TENDERS, "Wind Auction")).alias("tender"))
    return rows.groupBy("source", "relevant", "release", "hindi", "tender").agg(F.count("*").alias("n"))


NEWS_SQL = f"""
SELECT source, regexp_matches(title || ' ' || summary, '(?i){tx.WIND}') AS relevant, {tx.sql_first_match('title', tx.RELEASES, 'General')} AS release, regexp_matches(title, '[ऀ-ॿ]') AS hindi,
  CASE WHEN regexp_matches(title, '(?i){tx.TENDERS_KEPT}') THEN {tx.sql_first_match('title', tx.TENDERS, 'Wind Auction')} END AS tender, count(*) AS n FROM ({NEWS}) GROUP BY ALL
"""

FEED_STATES = ["Gujarat", "Tamil Nadu", "Karnataka", "Goa"]
FEED_ITEMS = 30


def news_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 items of each state: those that name it, or all where none does; of equal addresses the first counts, items about wind go first."""
    key = F.struct(F.col("item"))
    once = _news(spark, sf_dir).groupBy("url").agg(F.min_by(F.struct("item", "title", "summary", "published"), key).alias("i")).select("i.*")
    hay = F.lower(F.concat_ws(" ", "title", "summary"))
    names = F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(s.lower())), s) for s in FEED_STATES]))
    items = once.select("item", "title", "published", names.alias("names"), F.col("title").rlike("(?i)" + tx.ascii_words(tx.WIND)).alias("wind"))
    found = items.select(F.explode("names").alias("state")).distinct()
    every = spark.createDataFrame([(s,) for s in FEED_STATES], "state string")
    national = every.join(F.broadcast(found), "state", "left_anti").agg(F.sort_array(F.collect_list("state")).alias("states"))  # one row
    shown = items.crossJoin(F.broadcast(national)).select("item", "title", "published", "wind", F.explode(F.concat("names", "states")).alias("state"), F.col("states"))
    order = W.partitionBy("state").orderBy(F.col("wind").desc(), F.col("published").desc(), "item")
    return shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FEED_ITEMS).select("state", "place", "item", F.col("published").cast("string").alias("published"), F.array_contains("states", F.col("state")).alias("national"))


FEED_SQL = f"""
WITH o AS (SELECT * FROM ({NEWS}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY item) = 1),
s AS (SELECT unnest({FEED_STATES!r}) AS state), m AS (SELECT state, item, title, published FROM o JOIN s ON contains(lower(title || ' ' || summary), lower(state))),
a AS (SELECT *, false AS national FROM m UNION ALL SELECT state, item, title, published, true FROM o, s WHERE state NOT IN (SELECT state FROM m)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY regexp_matches(title, '(?i){tx.WIND}') DESC, published DESC, item) AS INT) AS place FROM a)
SELECT state, place, item, CAST(published AS VARCHAR) AS published, national FROM r WHERE place <= {FEED_ITEMS}
"""


def tariff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tariff events: by nation and kind how many, the latest day, and its newest order."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "order").when(F.col("o_orderpriority").startswith("2"), "amendment").otherwise("notice")
    events = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), kind.alias("kind")).agg(F.count("*").alias("n"), F.max(F.struct(F.to_date("o_orderdate").alias("day"), (-F.col("o_orderkey")).alias("key"))).alias("last"))
    by = events.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy(F.col("c_nationkey").alias("nation"), "kind").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return by.select("nation", "kind", "n", F.col("last.day").cast("string").alias("latest"), (-F.col("last.key")).alias("newest"))


TARIFF_SQL = """
SELECT c_nationkey AS nation, CASE WHEN o_orderpriority LIKE '1%' THEN 'order' WHEN o_orderpriority LIKE '2%' THEN 'amendment' ELSE 'notice' END AS kind, count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest,
  arg_min(o_orderkey, (-CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT), o_orderkey)) AS newest
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
"""


STATES = "ABCDE"


def _projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as projects (id, state, district, mw) whose districts are misspelt in several ways, and the districts (name, state)."""
    k, name = F.col("p_partkey"), F.col("p_name")
    part = table(spark, sf_dir, "part")
    spelt = (
        F.when(k % 11 == 0, F.concat(name, F.lit(" & "), name)).when(k % 13 == 0, F.lit("12")).when(k % 17 == 0, F.lit("Kutch")).when(k % 19 == 0, F.concat(F.lit("Qzx"), F.reverse(name)))
        .when(k % 9 == 0, F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)"))).when(k % 7 == 0, F.concat(F.substring(name, 1, 1), name)).otherwise(F.initcap(name))
    )
    state = lambda n: F.substring(F.lit("ABCDEF"), (F.pmod(k, F.lit(n)) + 1).cast("int"), F.lit(1))
    projects = part.select(k.alias("id"), F.lower(state(6)).alias("state"), spelt.alias("district"), F.col("p_size").alias("mw"))
    districts = part.select(F.regexp_replace(F.lower(name), "[^a-z]", "").alias("name"), state(5).alias("state")).distinct()
    return projects, districts.unionByName(spark.createDataFrame([("kachchh", "B")], "name string, state string"))


def _resolved_projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    projects, districts = _projects(spark, sf_dir)
    return resolved(projects, districts, tx.DISTRICT_ALIASES, tx.SEVERAL_DISTRICTS), districts


def district_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity by district where names are misspelt: by alias, else equal letters, else the best ratio of 0.9 or more. A district of several states is taken for that of its first project, or else the first."""
    found, districts = _resolved_projects(spark, sf_dir)
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    sums = found.where("name IS NOT NULL").groupBy("name").agg(F.sum("mw").alias("mw"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("district")), ",").alias("spellings"), F.min_by(plain(F.col("state")), "id").alias("wanted"))
    met = sums.join(districts.withColumnRenamed("state", "held"), "name")
    chosen = met.groupBy("name", "mw", "n", "spellings").agg(F.min(F.struct(F.col("wanted") != plain(F.col("held")), "held")).alias("c"))
    return chosen.select("name", F.col("c.held").alias("state"), "mw", "n", "spellings")


def district_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How projects found their district, and the share of all capacity of each way."""
    found, _ = _resolved_projects(spark, sf_dir)
    sums = found.groupBy("how").agg(F.count("*").alias("n"), F.sum("mw").alias("mw"))
    total = sums.agg(F.sum("mw").alias("all"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("how", "n", "mw", half_up(F.col("mw") / F.col("all") * 100, 1).alias("share"))


def district_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects over 20 MW that found no district, and why."""
    found, _ = _resolved_projects(spark, sf_dir)
    return found.where("name IS NULL AND mw > 20").select("id", "state", "district", "mw", "how")


#: The ratio by its law: the longest run of letters in common, the first of several, then what lies left and right of it.
PROJECTS_SQL = f"""
WITH RECURSIVE proj AS (SELECT p_partkey AS id, lower(substr('ABCDEF', CAST(p_partkey % 6 + 1 AS INT), 1)) AS state, p_size AS mw,
  CASE WHEN p_partkey % 11 = 0 THEN p_name || ' & ' || p_name WHEN p_partkey % 13 = 0 THEN '12' WHEN p_partkey % 17 = 0 THEN 'Kutch' WHEN p_partkey % 19 = 0 THEN 'Qzx' || reverse(p_name)
    WHEN p_partkey % 9 = 0 THEN substr(p_name, 1, 3) || substr(p_name, 5) WHEN p_partkey % 7 = 0 THEN substr(p_name, 1, 1) || p_name
    ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS district FROM part),
dist AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS name, substr('ABCDEF', CAST(p_partkey % 5 + 1 AS INT), 1) AS held FROM part UNION ALL SELECT 'kachchh', 'B'),
spelt AS (SELECT DISTINCT district, regexp_replace(lower(district), '[^a-z]', '', 'g') AS typed FROM proj),
sought AS (SELECT district, typed, CASE WHEN typed = 'kutch' THEN 'kachchh' ELSE typed END AS sought, CASE WHEN regexp_matches(district, '[&/,]| and |\\+') THEN 'combo' WHEN typed = '' THEN 'empty' END AS dropped FROM spelt),
known AS (SELECT DISTINCT name FROM dist), pair AS (SELECT DISTINCT sought AS b, name AS a FROM sought, known WHERE dropped IS NULL AND sought NOT IN (SELECT name FROM known) AND 2 * least(length(sought), length(name)) >= 0.9 * (length(sought) + length(name)) - 1e-9),
run AS (
  SELECT a, b, 0::BIGINT AS al, length(a)::BIGINT AS ah, 0::BIGINT AS bl, length(b)::BIGINT AS bh, 0::BIGINT AS m FROM pair
  UNION ALL
  SELECT a, b, s.al, s.ah, s.bl, s.bh, s.m FROM (
    SELECT a, b, unnest([{{'al': al, 'ah': i, 'bl': bl, 'bh': j, 'm': n}}, {{'al': i + n, 'ah': ah, 'bl': j + n, 'bh': bh, 'm': 0::BIGINT}}]) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY a, b, al, bl ORDER BY n DESC, i, j) AS k FROM (
        SELECT *, list_max(list_transform(range(0, least(ah - i, bh - j) + 1), lambda q: CASE WHEN substr(a, CAST(i + 1 AS INT), CAST(q AS INT)) = substr(b, CAST(j + 1 AS INT), CAST(q AS INT)) THEN q ELSE 0 END)) AS n
        FROM run, unnest(range(al, ah)) AS u(i), unnest(range(bl, bh)) AS v(j))) WHERE k = 1 AND n > 0)
), best AS (SELECT b, arg_max(a, {{'r': r, 'a': a}}) AS fuzzy FROM (SELECT a, b, 2.0::DOUBLE * sum(m)::DOUBLE / (length(a) + length(b)) AS r FROM run GROUP BY a, b) WHERE r >= 0.9 GROUP BY b),
res AS (SELECT s.district, CASE WHEN dropped IS NULL THEN coalesce(k.name, fuzzy) END AS name, coalesce(dropped, CASE WHEN k.name IS NOT NULL THEN CASE WHEN sought <> typed THEN 'alias' ELSE 'exact' END WHEN fuzzy IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END) AS how FROM sought s LEFT JOIN known k ON k.name = s.sought LEFT JOIN best ON best.b = s.sought),
found AS (SELECT proj.*, name, how FROM proj JOIN res USING (district))
"""
DISTRICT_SQL = PROJECTS_SQL + """, sums AS (SELECT name, sum(mw) AS mw, count(*) AS n, array_to_string(list_sort(list(DISTINCT district)), ',') AS spellings, arg_min(state, id) AS wanted FROM found WHERE name IS NOT NULL GROUP BY name)
SELECT name, coalesce(min(held) FILTER (lower(held) = wanted), min(held)) AS state, CAST(mw AS BIGINT) AS mw, n, spellings FROM sums JOIN dist USING (name) GROUP BY name, mw, n, spellings, wanted
"""
MATCHES_SQL = PROJECTS_SQL + "SELECT how, count(*) AS n, CAST(sum(mw) AS BIGINT) AS mw, floor(sum(mw)::DOUBLE / (SELECT sum(mw) FROM found)::DOUBLE * 100 * 10 + 0.5) / 10 AS share FROM found GROUP BY how"
DROPS_SQL = PROJECTS_SQL + "SELECT id, state, district, mw, how FROM found WHERE name IS NULL AND mw > 20"

DBSCAN_KM, DBSCAN_POINTS = 60.0, 4


def dbscan_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of masts: cores with 4 points (themselves too) within 60 km, and what lies within 60 km of a core.

    Clusters grow over cells whose points are all in reach of each other, and a
    border point goes to the least of the clusters around it.
    """
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), synthetic_lon(k * 3 + 1).alias("lon"), synthetic_lat(k * 5 + 2).alias("lat"))
    return clusters(points, DBSCAN_KM, DBSCAN_POINTS).select(F.col("id").alias("mast"), "cluster")


DBSCAN_SQL = f"""
WITH RECURSIVE m AS ({MASTS}), p AS (
  SELECT a.mast AS a, b.mast AS b FROM (SELECT mast, plon AS lon, plat AS lat FROM m) a, m b WHERE abs(a.lat - b.plat) < 0.6 AND {sql_haversine('lon', 'lat', 'plon', 'plat')} <= 60
), c AS (SELECT a AS core FROM p GROUP BY a HAVING count(*) >= 4), e AS (SELECT a, b FROM p WHERE a IN (SELECT core FROM c) AND b IN (SELECT core FROM c)),
r AS (SELECT core AS a, core AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), k AS (SELECT a AS core, min(b) AS cluster FROM r GROUP BY a)
SELECT p.a AS mast, min(cluster) AS cluster FROM p JOIN k ON p.b = k.core GROUP BY p.a
"""

QUERIES = {f.__name__: f for f in (html_strip, html_row_extract, parse_power_voltage, event_properties, classify_features, query_rewrite, news_categories, news_feed, tariff_events, district_rollup, district_matches, district_drops, dbscan_settlements)}
SQL = {"html_strip": STRIP_SQL, "html_row_extract": ROWS_SQL, "parse_power_voltage": PARSE_SQL, "event_properties": PROPS_SQL, "classify_features": CLASSIFY_SQL, "query_rewrite": _rewrite_sql(), "news_categories": NEWS_SQL, "news_feed": FEED_SQL, "tariff_events": TARIFF_SQL, "district_rollup": DISTRICT_SQL, "district_matches": MATCHES_SQL, "district_drops": DROPS_SQL, "dbscan_settlements": DBSCAN_SQL}
