"""Project finance queries: cash flows, returns, sensitivity, Monte Carlo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions import finance as fin
from siteloom.functions import wind
from siteloom.functions.geo import haversine_km
from siteloom.functions.numeric import half_up, sql_piecewise
from siteloom.operators.ranking import if_small
from siteloom.operators.spatial import nearest
from siteloom.plans.tables import table
from siteloom.plans.wind import SCORED_SQL, SITES_SQL, _r, scored, sites

TARIFF = fin.PPA + fin.REC + fin.TOD + fin.CARBON


def _yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with their yearly energy per MW."""
    return sites(spark, sf_dir).withColumn("mwh", wind.cuf(F.col("speed")) * F.lit(fin.HOURS))


def _flows(mwh: Column) -> Column:
    return fin.equity_flows(mwh, F.lit(TARIFF), F.lit(fin.CAPEX_CR), F.lit(fin.OM_CR), F.lit(fin.INTEREST))


def cashflow_irr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity and project rate of return and the year the equity is paid back."""
    rows = _yields(spark, sf_dir).select("site", _flows(F.col("mwh")).alias("equity"), fin.project_flows(F.col("mwh"), F.lit(TARIFF), F.lit(fin.CAPEX_CR), F.lit(fin.OM_CR)).alias("project"))
    return rows.select("site", half_up(fin.irr("equity"), 6).alias("equity_irr"), half_up(fin.irr("project"), 6).alias("project_irr"), fin.first_year_paid(F.col("equity")).alias("payback"))


YIELDS_SQL = f"SELECT *, {sql_piecewise('speed', wind.CUF_CURVE)} * 8766.0::DOUBLE AS mwh FROM ({SITES_SQL})"


def _equity_sql(mwh: str, tariff: str = "4.5::DOUBLE", capex: str = "9.0::DOUBLE", om: str = "0.13::DOUBLE", rate: str = "0.095::DOUBLE") -> str:
    c = f"({capex} * 1e7::DOUBLE)"
    income, upkeep = f"({mwh} * 1000 * {tariff})", f"({om} * 1e7::DOUBLE * pow(1.05::DOUBLE, y - 1))"
    due = f"(CASE WHEN y <= 15 THEN {c} * 0.75::DOUBLE * (1 - (y - 1) / 15.0::DOUBLE) * {rate} ELSE 0 END)"
    back = f"(CASE WHEN y <= 15 THEN {c} * 0.75::DOUBLE / 15 ELSE 0 END)"
    gain = f"({income} - {upkeep} - {due} - {_dep(c)})"
    return f"list_concat([-({c} - {c} * 0.75::DOUBLE)], list_transform(range(1, 21), lambda y: {income} - {upkeep} - {due} - {back} - CASE WHEN {gain} > 0 THEN {gain} * 0.1747::DOUBLE ELSE 0 END))"


def _dep(c: str) -> str:
    return f"(CASE WHEN y <= 15 THEN greatest(0, least({c} * 0.0467::DOUBLE, {c} * 0.9::DOUBLE - {c} * 0.0467::DOUBLE * (y - 1))) ELSE 0 END)"


def _project_sql(mwh: str) -> str:
    c = "(9.0::DOUBLE * 1e7::DOUBLE)"
    income, upkeep = f"({mwh} * 1000 * 4.5::DOUBLE)", "(0.13::DOUBLE * 1e7::DOUBLE * pow(1.05::DOUBLE, y - 1))"
    gain = f"({income} - {upkeep} - {_dep(c)})"
    return f"list_concat([-{c}], list_transform(range(1, 21), lambda y: {income} - {upkeep} - CASE WHEN {gain} > 0 THEN {gain} * 0.1747::DOUBLE ELSE 0 END))"


def _npv_sql(rate: str, flows: str) -> str:
    return f"list_sum(list_transform({flows}, lambda c, t: c / pow(1 + {rate}, t - 1)))"


def _irr_sql(source: str, key: str, flows: str) -> str:
    """Bisection as a recursive query: (key, irr) of the rows of ``source``."""
    mid = "(lo + hi) / 2"
    return f"""(WITH RECURSIVE b AS (
      SELECT {key}, {flows} AS f, -0.95::DOUBLE AS lo, 3.0::DOUBLE AS hi, {_npv_sql('-0.95::DOUBLE', flows)} AS at_low, 0 AS step FROM {source} WHERE {_npv_sql('-0.95::DOUBLE', flows)} * {_npv_sql('3.0::DOUBLE', flows)} <= 0
      UNION ALL SELECT {key}, f, CASE WHEN at_low * here < 0 THEN lo ELSE {mid} END, CASE WHEN at_low * here < 0 THEN {mid} ELSE hi END, CASE WHEN at_low * here < 0 THEN at_low ELSE here END, step + 1
      FROM (SELECT *, {_npv_sql(mid, 'f')} AS here FROM b WHERE step < 60)
    ) SELECT {key}, {mid} AS irr FROM b WHERE step = 60)"""


IRR_SQL = f"""
WITH y AS ({YIELDS_SQL}), f AS (SELECT site, {_equity_sql('mwh')} AS e, {_project_sql('mwh')} AS p FROM y),
a AS (SELECT * FROM {_irr_sql('f', 'site', 'e')}), b AS (SELECT * FROM {_irr_sql('f', 'site', 'p')}),
c AS (SELECT site, min(y) AS payback FROM (SELECT site, unnest(range(1, 21)) AS y, e FROM f) WHERE list_sum(e[1:y + 1]) >= 0 GROUP BY site)
SELECT f.site, {_r('a.irr')} AS equity_irr, {_r('b.irr')} AS project_irr, CAST(payback AS INT) AS payback FROM f LEFT JOIN a USING (site) LEFT JOIN b USING (site) LEFT JOIN c USING (site)
"""


def lcoe_npv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present value of the equity (crore) and levelised cost of energy."""
    y = F.sequence(F.lit(1), F.lit(fin.LIFE))
    add = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    energy = add(F.transform(y, lambda t: F.col("mwh") * 1000 / F.pow(F.lit(1 + fin.DISCOUNT), t)))
    cost = F.lit(fin.CAPEX_CR * 1e7) + add(F.transform(y, lambda t: F.lit(fin.OM_CR * 1e7) * F.pow(F.lit(fin.OM_GROWTH), t - 1) / F.pow(F.lit(1 + fin.DISCOUNT), t)))
    return _yields(spark, sf_dir).select("site", half_up(fin.npv(fin.DISCOUNT, _flows(F.col("mwh"))) / 1e7, 5).alias("npv"), half_up(F.try_divide(cost, energy), 5).alias("lcoe"))


LCOE_SQL = f"""
SELECT site, {_r(_npv_sql('0.1::DOUBLE', _equity_sql('mwh')) + ' / 1e7::DOUBLE', 5)} AS npv,
  {_r("(9e7::DOUBLE + list_sum(list_transform(range(1, 21), lambda t: 0.13::DOUBLE * 1e7::DOUBLE * pow(1.05::DOUBLE, t - 1) / pow(1.1::DOUBLE, t)))) / list_sum(list_transform(range(1, 21), lambda t: mwh * 1000 / pow(1.1::DOUBLE, t)))", 5)} AS lcoe
FROM ({YIELDS_SQL})
"""

# Fixed values of the bankability model.
BANK = {"hours": 8760.0, "aux": 0.005, "fade": 0.005, "om_growth": 0.05, "insurance": 0.004, "insurance_growth": 0.03, "tax": 0.25168, "salvage": 0.05, "life": 25, "tenor": 14, "rate": 0.095, "debt": 0.7, "tariff": 3.6, "cost": 8.0, "om": 0.13, "wdv": 0.4}


def bankability_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annuity debt, declining-balance tax, debt cover and returns over 25 years for each site, per MW.

    The loan and the written-down value are carried from year to year by one
    fold over the years.
    """
    b = BANK
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), (F.lit(0.25) + F.pmod(k, F.lit(20)) / F.lit(100.0)).alias("plf"))
    r, n = b["rate"], b["tenor"]
    debt = b["cost"] * b["debt"]
    annuity = debt * (r * (1 + r) ** n) / ((1 + r) ** n - 1)
    revenue1 = F.col("plf") * F.lit(b["hours"] * (1 - b["aux"]) * b["tariff"] * 1000 / 1e7)
    start = F.struct(F.lit(debt).alias("owed"), F.lit(b["cost"]).alias("wdv"), F.array().cast("array<double>").alias("equity"), F.array().cast("array<double>").alias("project"), F.array().cast("array<double>").alias("cover"))

    def year(s: Column, y: Column) -> Column:
        earned = revenue1 * F.pow(F.lit(1 - b["fade"]), y - 1) - F.lit(b["om"]) * F.pow(F.lit(1 + b["om_growth"]), y - 1) - F.lit(b["cost"] * b["insurance"]) * F.pow(F.lit(1 + b["insurance_growth"]), y - 1)
        interest = s["owed"] * F.lit(r)
        repaid = F.when(y <= n, F.least(F.lit(annuity) - interest, s["owed"])).otherwise(0.0)
        off = s["wdv"] * F.lit(b["wdv"])
        free = earned - F.greatest(F.lit(0.0), earned - off) * F.lit(b["tax"])
        levered = earned - F.when(y <= n, F.lit(annuity)).otherwise(0.0) - F.greatest(F.lit(0.0), earned - off - interest) * F.lit(b["tax"])
        return F.struct(F.greatest(F.lit(0.0), s["owed"] - repaid).alias("owed"), (s["wdv"] - off).alias("wdv"), F.concat(s["equity"], F.array(levered)).alias("equity"), F.concat(s["project"], F.array(free)).alias("project"), F.when(y <= n, F.concat(s["cover"], F.array(earned / F.lit(annuity)))).otherwise(s["cover"]).alias("cover"))

    run = rows.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(b["life"])), start, year)).withColumn("wc", revenue1 / 12)
    salvage = b["cost"] * b["salvage"]
    last = F.lit(salvage) - F.greatest(F.lit(0.0), F.lit(salvage) - F.col("s.wdv")) * F.lit(b["tax"]) + F.col("wc")
    ended = lambda flows, own: F.concat(F.array(-(F.lit(own) + F.col("wc"))), F.transform(flows, lambda c, i: F.when(i == b["life"] - 1, c + last).otherwise(c)))
    done = run.select("site", ended(F.col("s.equity"), b["cost"] - debt).alias("equity"), ended(F.col("s.project"), b["cost"]).alias("project"), (F.aggregate("s.cover", F.lit(0.0), lambda a, x: a + x) / n).alias("avg_cover"), F.array_min("s.cover").alias("min_cover"))
    done = done.select("site", (fin.irr("equity") * 100).alias("equity_irr"), (fin.irr("project") * 100).alias("project_irr"), "avg_cover", "min_cover")
    verdict = F.when((F.col("equity_irr") >= 13) & (F.col("avg_cover") >= 1.3), "Bankable").when((F.col("equity_irr") >= 11) & (F.col("avg_cover") >= 1.15), "Marginal").otherwise("Sub-bankable")
    return done.select("site", *[half_up(F.col(c), 4).alias(c) for c in ("equity_irr", "project_irr", "avg_cover", "min_cover")], verdict.alias("verdict"))


def _bank_sql() -> str:
    b = BANK
    debt = b["cost"] * b["debt"]
    annuity = debt * (b["rate"] * (1 + b["rate"]) ** b["tenor"]) / ((1 + b["rate"]) ** b["tenor"] - 1)
    d = lambda x: f"{x!r}::DOUBLE"
    revenue = f"plf * {d(b['hours'] * (1 - b['aux']) * b['tariff'] * 1000 / 1e7)}"
    salvage = d(b["cost"] * b["salvage"])
    return f"""
WITH RECURSIVE s AS (SELECT s_suppkey AS site, 0.25::DOUBLE + (s_suppkey % 20) / 100.0::DOUBLE AS plf FROM supplier),
r AS (
  SELECT site, plf, 0 AS y, {d(debt)} AS owed, {d(b['cost'])} AS wdv, 0.0::DOUBLE AS earned, 0.0::DOUBLE AS equity, 0.0::DOUBLE AS project FROM s
  UNION ALL
  SELECT site, plf, y, greatest(0.0::DOUBLE, owed - CASE WHEN y <= {b['tenor']} THEN least({d(annuity)} - owed * {d(b['rate'])}, owed) ELSE 0 END), wdv - wdv * 0.4::DOUBLE, earned,
    earned - CASE WHEN y <= {b['tenor']} THEN {d(annuity)} ELSE 0 END - greatest(0, earned - wdv * 0.4::DOUBLE - owed * {d(b['rate'])}) * {d(b['tax'])}, earned - greatest(0, earned - wdv * 0.4::DOUBLE) * {d(b['tax'])}
  FROM (SELECT site, plf, y + 1 AS y, owed, wdv, {revenue} * pow(0.995::DOUBLE, y) - 0.13::DOUBLE * pow(1.05::DOUBLE, y) - {d(b['cost'] * b['insurance'])} * pow(1.03::DOUBLE, y) AS earned FROM r WHERE y < 25)
), l AS (
  SELECT site, y, earned, CASE WHEN y = 25 THEN {salvage} - greatest(0, {salvage} - wdv) * {d(b['tax'])} + {revenue} / 12 ELSE 0 END AS last, equity, project, {revenue} / 12 AS wc FROM r
), f AS (
  SELECT site, list(CASE WHEN y = 0 THEN -({d(b['cost'] - debt)} + wc) ELSE equity + last END ORDER BY y) AS e, list(CASE WHEN y = 0 THEN -({d(b['cost'])} + wc) ELSE project + last END ORDER BY y) AS p,
    sum(earned / {d(annuity)}) FILTER (y BETWEEN 1 AND {b['tenor']}) / {b['tenor']} AS avg_cover, min(earned / {d(annuity)}) FILTER (y BETWEEN 1 AND {b['tenor']}) AS min_cover FROM l GROUP BY site
), a AS (SELECT * FROM {_irr_sql('f', 'site', 'e')}), c AS (SELECT * FROM {_irr_sql('f', 'site', 'p')})
SELECT f.site, {_r('a.irr * 100', 4)} AS equity_irr, {_r('c.irr * 100', 4)} AS project_irr, {_r('avg_cover', 4)} AS avg_cover, {_r('min_cover', 4)} AS min_cover,
  CASE WHEN a.irr * 100 >= 13 AND avg_cover >= 1.3 THEN 'Bankable' WHEN a.irr * 100 >= 11 AND avg_cover >= 1.15 THEN 'Marginal' ELSE 'Sub-bankable' END AS verdict
FROM f LEFT JOIN a USING (site) LEFT JOIN c USING (site)
"""


def prng_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number every customer key draws from the seeded sequence, and its triangular value."""
    u = fin.uniform(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", u.alias("u"), half_up(fin.triangular(u, *fin.DRAWS["ppa"]), 8).alias("ppa"))


def _mul_sql(a: str, b: str) -> str:
    return f"((((({a}) >> 16) * ({b})) & 65535) * 65536 + (({a}) & 65535) * ({b})) & 4294967295"


PRNG_SQL = f"""
WITH a AS (SELECT c_custkey, (42 + ({_mul_sql('(c_custkey + 1) & 4294967295', '1831565813::BIGINT')})) & 4294967295 AS a FROM customer),
b AS (SELECT c_custkey, {_mul_sql('xor(a, a >> 15)', '(a | 1)')} AS t FROM a), c AS (SELECT c_custkey, xor((t + ({_mul_sql('xor(t, t >> 7)', '(t | 61)')})) & 4294967295, t) AS t FROM b),
d AS (SELECT c_custkey, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM c)
SELECT c_custkey, u, {_r("CASE WHEN u < 0.5 THEN 3.3::DOUBLE + sqrt(u * 0.4::DOUBLE * 0.2::DOUBLE) ELSE 3.7::DOUBLE - sqrt((1 - u) * 0.4::DOUBLE * 0.2::DOUBLE) END", 8)} AS ppa FROM d
"""

RUNS = 4000


def draws(spark: SparkSession, runs: int = RUNS) -> DataFrame:
    """One row per run with its value of each of the model's eight draws, the same for every site."""
    values = [fin.triangular(fin.uniform(F.col("id") * len(fin.DRAWS) + i), *bounds).alias(name) for i, (name, bounds) in enumerate(fin.DRAWS.items())]
    return spark.range(runs).select(F.col("id").alias("run"), *values)


def simulated(spark: SparkSession, rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """site, run and irr: every site's equity return under every run.

    The runs are a fixed table and are broadcast to the sites, which stay
    where they are; only the returns' percentiles are shuffled.
    """
    drawn = draws(spark, runs).withColumn("tariff", F.col("ppa") + F.col("rec") + F.col("tod") + F.col("carbon")).withColumnRenamed("om", "om_cr").withColumnRenamed("capex", "capex_cr")
    met = rows.crossJoin(F.broadcast(drawn))
    return met.select("site", "run", fin.equity_irr(F.col("cuf") * F.col("cuf_scale") * F.lit(fin.HOURS), "tariff", "capex_cr", "om_cr", "interest").alias("irr"))


def monte_carlo_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the equity return over 4000 runs for each distinct wind speed of the sites."""
    classes = sites(spark, sf_dir).groupBy("speed").agg(F.min("site").alias("site"), F.count("*").alias("sites")).withColumn("cuf", wind.cuf(F.col("speed")))
    spread = classes.repartition(spark.sparkContext.defaultParallelism, "site")  # few rows, each of much work
    found = simulated(spark, spread.select("site", "cuf")).groupBy("site").agg(F.count("irr").alias("n"), F.percentile("irr", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("p"))
    names = ("p10", "p25", "p50", "p75", "p90")
    banded = found.select("site", "n", *[half_up(F.when(F.col("n") >= 10, F.get("p", F.lit(i))), 6).alias(x) for i, x in enumerate(names)])
    return banded.join(classes.select("site", "speed", "sites"), "site").select("speed", "sites", "n", *names)


def irr_histogram(spark: SparkSession, sf_dir: str, bins: int = 24) -> DataFrame:
    """Counts of 24 equal bins over the sites' returns, the largest in the last bin."""
    rows = cashflow_irr(spark, sf_dir).where("equity_irr IS NOT NULL").select("equity_irr")
    ends = rows.agg(F.min("equity_irr").alias("low"), F.max("equity_irr").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    bin_of = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("equity_irr") - F.col("low")) / width).cast("int"))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


HIST_SQL = f"""
WITH i AS ({IRR_SQL}), e AS (SELECT min(equity_irr) AS lo, max(equity_irr) AS hi FROM i)
SELECT CAST(CASE WHEN hi > lo THEN least(23, floor((equity_irr - lo) / ((hi - lo) / 24))) ELSE 0 END AS INT) AS bin, count(*) AS n FROM i, e WHERE equity_irr IS NOT NULL GROUP BY 1
"""

#: What the tornado moves, from the least to the most of its bounds.
ARMS = ("ppa", "rec", "tod", "carbon", "om", "interest", "capex", "cuf_scale")


def sensitivity_tornado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each input, moved alone to either bound, moves a site's return; largest first. An arm without a return at one end moves it beyond measure and comes first; sites without a return of their own are left out."""
    base = {"ppa": fin.PPA, "rec": fin.REC, "tod": fin.TOD, "carbon": fin.CARBON, "om": fin.OM_CR, "interest": fin.INTEREST, "capex": fin.CAPEX_CR, "cuf_scale": 1.0}
    arm = lambda name, side, moved: F.struct(F.lit(name).alias("arm"), F.lit(side).alias("side"), *[F.lit(float(moved if k == name else v)).alias(k) for k, v in base.items()])
    arms = F.array(arm("base", "base", 0), *[arm(a, s, fin.DRAWS[a][i]) for a in ARMS for s, i in (("low", 0), ("high", 2))])
    rows = sites(spark, sf_dir).select("site", wind.cuf(F.col("speed")).alias("cuf"), F.explode(arms).alias("a")).select("site", "cuf", "a.*")
    flows = fin.equity_flows(F.col("cuf") * F.col("cuf_scale") * F.lit(fin.HOURS), F.col("ppa") + F.col("rec") + F.col("tod") + F.col("carbon"), F.col("capex"), F.col("om"), F.col("interest"))
    found = rows.select("site", "arm", "side", fin.irr(flows).alias("irr"))
    by = lambda side: F.max(F.when(F.col("side") == side, F.col("irr")))
    wide = found.where("side <> 'base'").groupBy("site", "arm").agg(by("low").alias("low"), by("high").alias("high"))
    zero = found.where("side = 'base' AND irr IS NOT NULL").select("site", F.col("irr").alias("base"))
    moved = wide.join(zero, "site").select("site", "arm", half_up(F.col("low") - F.col("base"), 6).alias("low"), half_up(F.col("high") - F.col("base"), 6).alias("high"))
    order = F.when(F.col("low").isNull() | F.col("high").isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.abs("low"), F.abs("high"))).desc()
    return moved.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy(order, "arm")))


def nearby_better_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 24 points in three rings around each site, the best whose score is over half a point higher."""
    rows = scored(sites(spark, sf_dir)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(23))))
    speed = F.col("speed") + (F.pmod(F.col("site") * 7 + F.col("i") * 13, F.lit(41)) - 20) / F.lit(20.0)
    there = rows.select("site", F.col("score").alias("own"), "i", (F.floor(F.col("i") / 8) * 5 + 5).cast("int").alias("ring_km"), speed.alias("speed"), "line_km", "sub_km")
    return nearest(scored(there).where("score > own + 0.5"), "site", [F.col("score").desc(), "i"]).select("site", "own", "i", "ring_km", "score")


NEARBY_SQL = f"""
WITH o AS ({SCORED_SQL}), t AS (
  SELECT site, score AS own, CAST(i AS INT) AS i, CAST(i // 8 * 5 + 5 AS INT) AS ring_km, speed + ((site * 7 + i * 13) % 41 - 20) / 20.0::DOUBLE AS speed, line_km, sub_km FROM o, range(24) AS r(i)
)
SELECT site, own, i, ring_km, score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, i) AS n FROM ({SCORED_SQL.replace(SITES_SQL, 'SELECT * FROM t')}) WHERE score > own + 0.5) WHERE n = 1
"""

# Fixed values of the logistics model.
TRAILER_RATES = {"standard": 70, "blade": 115, "hydraulic": 185}
CRANES = [(40.0, 100, 30000), (80.0, 250, 90000), (120.0, 400, 300000), (1e12, 750, 600000)]


MOST_PLANTS = 10_000


def logistics_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest plant that makes each of four components, for every site; plants are a fixed list."""
    from siteloom.functions.geo import ROUTE_EARTH_KM, synthetic_lat, synthetic_lon

    plants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("plant"), synthetic_lon(F.col("n_nationkey") * 211).alias("plon"), synthetic_lat(F.col("n_nationkey") * 307).alias("plat"), F.pmod("n_nationkey", F.lit(4)).cast("int").alias("component"))
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), synthetic_lon(k).alias("lon"), synthetic_lat(k).alias("lat"))
    if plants.limit(MOST_PLANTS + 1).count() > MOST_PLANTS:
        raise ValueError(f"a catalogue of over {MOST_PLANTS} plants needs a search by cells, see operators.proximity")
    pairs = rows.crossJoin(F.broadcast(plants))  # every site against the catalogue of plants, of a checked size
    km = haversine_km(*[F.col(c) for c in ("lon", "lat", "plon", "plat")], ROUTE_EARTH_KM) * 1.3
    best = pairs.withColumn("km", km).groupBy("site", "component").agg(F.min(F.struct("km", "plant")).alias("b"))
    return best.select("site", "component", F.col("b.plant").alias("plant"), half_up(F.col("b.km"), 3).alias("km"), half_up(F.col("b.km") / 40, 3).alias("hours"))


def _origin_sql() -> str:
    from siteloom.functions.geo import ROUTE_EARTH_KM, sql_haversine, sql_lat, sql_lon

    return f"""
SELECT site, component, plant, floor(km * 1000 + 0.5) / 1000 AS km, floor(km / 40 * 1000 + 0.5) / 1000 AS hours FROM (
  SELECT *, row_number() OVER (PARTITION BY site, component ORDER BY km, plant) AS n FROM (
    SELECT site, component, plant, {sql_haversine('lon', 'lat', 'plon', 'plat', ROUTE_EARTH_KM)} * 1.3::DOUBLE AS km
    FROM (SELECT s_suppkey AS site, {sql_lon('s_suppkey')} AS lon, {sql_lat('s_suppkey')} AS lat FROM supplier),
      (SELECT n_nationkey AS plant, CAST(n_nationkey % 4 AS INT) AS component, {sql_lon('n_nationkey * 211')} AS plon, {sql_lat('n_nationkey * 307')} AS plat FROM nation))) WHERE n = 1"""


COMPONENTS = ("blade", "nacelle", "tower", "hub")


def component_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each component of a site's turbines comes from: the nearest plant of its maker, still at work, that makes it; else its maker's nearest plant at work; else its maker's first plant."""
    from siteloom.functions.geo import ROUTE_EARTH_KM, synthetic_lat, synthetic_lon

    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    makes = F.when(n % 3 == 0, F.array(F.lit("blade"), F.lit("tower"))).when(n % 3 == 1, F.array(F.lit("nacelle"))).otherwise(F.array(F.lit("hub"), F.lit("blade")))
    plants = table(spark, sf_dir, "nation").select(n.alias("plant"), F.pmod(n, F.lit(6)).alias("maker"), ((n % 4 == 0) | (n % 6 == 5)).alias("legacy"), makes.alias("products"), synthetic_lon(n * 211).alias("plon"), synthetic_lat(n * 307).alias("plat"))
    sites = table(spark, sf_dir, "supplier").select(k.alias("site"), F.pmod(k, F.lit(6)).alias("maker"), synthetic_lon(k).alias("lon"), synthetic_lat(k).alias("lat"), F.explode(F.array(*[F.lit(c) for c in COMPONENTS])).alias("component"))
    km = haversine_km(*[F.col(c) for c in ("lon", "lat", "plon", "plat")], ROUTE_EARTH_KM)
    tier = F.when(~F.col("legacy") & F.array_contains("products", F.col("component")), 1).when(~F.col("legacy"), 2).otherwise(3)
    met = sites.join(if_small(plants), "maker").withColumns({"tier": tier, "km": km})
    best = met.groupBy("site", "component").agg(F.min(F.struct("tier", F.when(F.col("tier") < 3, F.col("km")).otherwise(0.0).alias("by"), "plant", "km")).alias("b"))
    return best.select("site", "component", F.col("b.plant").alias("plant"), (F.col("b.tier") > 1).alias("sourced_locally"), half_up(F.col("b.km"), 3).alias("km"))


def _origins_sql() -> str:
    from siteloom.functions.geo import ROUTE_EARTH_KM, sql_haversine, sql_lat, sql_lon

    return f"""
WITH p AS (SELECT n_nationkey AS plant, n_nationkey % 6 AS maker, n_nationkey % 4 = 0 OR n_nationkey % 6 = 5 AS legacy, CASE n_nationkey % 3 WHEN 0 THEN ['blade', 'tower'] WHEN 1 THEN ['nacelle'] ELSE ['hub', 'blade'] END AS products, {sql_lon('n_nationkey * 211')} AS plon, {sql_lat('n_nationkey * 307')} AS plat FROM nation),
s AS (SELECT s_suppkey AS site, s_suppkey % 6 AS maker, {sql_lon('s_suppkey')} AS lon, {sql_lat('s_suppkey')} AS lat, unnest({list(COMPONENTS)!r}) AS component FROM supplier),
m AS (SELECT *, {sql_haversine('lon', 'lat', 'plon', 'plat', ROUTE_EARTH_KM)} AS km, CASE WHEN NOT legacy AND list_contains(products, component) THEN 1 WHEN NOT legacy THEN 2 ELSE 3 END AS tier FROM s JOIN p USING (maker))
SELECT site, component, plant, tier > 1 AS sourced_locally, floor(km * 1000 + 0.5) / 1000 AS km FROM (SELECT *, row_number() OVER (PARTITION BY site, component ORDER BY tier, CASE WHEN tier < 3 THEN km ELSE 0 END, plant) AS n FROM m) WHERE n = 1"""


def logistics_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport, crane and total cost of each plan: a supplier's parts as shipments of heavy loads."""
    k = F.col("l_partkey")
    loads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), (F.pmod(k, F.lit(90)) + 10).cast("double").alias("tonnes"), (F.pmod(k, F.lit(40)) + 5).cast("double").alias("metres"), (F.pmod(k * 3, F.lit(900)) + 50).cast("double").alias("km"), F.col("l_linenumber").alias("count"))
    rate = F.when(F.col("tonnes") > 45, TRAILER_RATES["hydraulic"]).when(F.col("metres") > 30, TRAILER_RATES["blade"]).otherwise(TRAILER_RATES["standard"])
    days = F.greatest(F.lit(1), F.ceil(F.col("km") / 150))
    odd = (F.col("tonnes") > 55) | (F.col("metres") > 30)
    cost = F.col("count") * F.col("km") * rate + F.col("count") * 2 * 3000 * days + F.when(odd, F.col("count") * 5000 * days).otherwise(0) + F.col("count") * (F.ceil(F.col("km") / 50) * 1000 + 30000)
    sums = loads.groupBy("plan").agg(F.sum(cost.cast("double")).alias("transport"), F.max("tonnes").alias("heaviest"), F.count_if(odd).alias("odd_loads"))
    crane = F.lit(None).cast("int")
    for most, _, day in reversed(CRANES):
        crane = F.when(F.col("heaviest") <= most, F.lit(day)).otherwise(crane)
    return sums.withColumn("crane", (crane * 3 + 2000000).cast("double")).select("plan", "transport", "heaviest", "odd_loads", "crane", half_up(F.col("transport") * 1.05 + F.col("crane") * 1.18, 2).alias("total"))


COST_SQL = """
WITH l AS (SELECT l_orderkey AS plan, (l_partkey % 90 + 10)::DOUBLE AS t, (l_partkey % 40 + 5)::DOUBLE AS m, (l_partkey * 3 % 900 + 50)::DOUBLE AS km, l_linenumber AS n FROM lineitem),
c AS (SELECT *, t > 55 OR m > 30 AS odd, greatest(1, ceil(km / 150)) AS days FROM l),
s AS (SELECT plan, sum(n * km * CASE WHEN t > 45 THEN 185 WHEN m > 30 THEN 115 ELSE 70 END + n * 6000 * days + CASE WHEN odd THEN n * 5000 * days ELSE 0 END + n * (ceil(km / 50) * 1000 + 30000)) AS transport,
  max(t) AS heaviest, count(*) FILTER (odd) AS odd_loads FROM c GROUP BY plan),
k AS (SELECT *, (CASE WHEN heaviest <= 40 THEN 30000 WHEN heaviest <= 80 THEN 90000 WHEN heaviest <= 120 THEN 300000 ELSE 600000 END * 3 + 2000000)::DOUBLE AS crane FROM s)
SELECT *, floor((transport * 1.05::DOUBLE + crane * 1.18::DOUBLE) * 100 + 0.5) / 100 AS total FROM k
"""

QUERIES = {f.__name__: f for f in (cashflow_irr, lcoe_npv, bankability_dcf, prng_draws, monte_carlo_band, irr_histogram, sensitivity_tornado, nearby_better_site, logistics_origin, component_origins, logistics_cost)}
SQL = {"cashflow_irr": IRR_SQL, "lcoe_npv": LCOE_SQL, "bankability_dcf": _bank_sql(), "prng_draws": PRNG_SQL, "irr_histogram": HIST_SQL, "nearby_better_site": NEARBY_SQL, "logistics_origin": _origin_sql(), "component_origins": _origins_sql(), "logistics_cost": COST_SQL}
