"""Wind resource, energy and screening queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import wind
from siteloom.functions.numeric import clamp, half_up, sql_piecewise
from siteloom.operators.ranking import global_rank, quantiles
from siteloom.plans.tables import table


def zonal_wind_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the finite pixels of each zone; ``exceed90`` is the speed 90 % of the area exceeds."""
    pixels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), (F.lit(4.0) + F.col("p_size") / F.lit(10.0)).alias("v"))
    finite = pixels.where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = finite.groupBy("site").agg(F.count("*").alias("pixels"), half_up(F.avg("v"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    names = {0.1: "exceed90", 0.25: "p25", 0.5: "p50", 0.75: "p75"}
    places = quantiles(finite, "v", list(names), "site").groupBy("site").agg(*[half_up(F.max(F.when(F.col("share") == s, F.col("v"))), 6).alias(n) for s, n in names.items()])
    return rows.join(places, "site").select("site", "pixels", "mean", "least", "most", *names.values())


ZONAL_SQL = """
SELECT p_brand AS site, count(*) AS pixels, floor(avg(v) * 10000 + 0.5) / 10000 AS mean, min(v) AS least, max(v) AS most,
  floor(quantile_cont(v, 0.1) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS exceed90, floor(quantile_cont(v, 0.25) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS p25,
  floor(quantile_cont(v, 0.5) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS p50, floor(quantile_cont(v, 0.75) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS p75
FROM (SELECT p_brand, 4.0::DOUBLE + p_size / 10.0::DOUBLE AS v FROM part) GROUP BY p_brand
"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidate sites with a wind speed and distances to the grid, some unknown."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("site"), (F.lit(4.0) + F.pmod(k * 37, F.lit(500)) / F.lit(100.0)).alias("speed"),
        F.when(k % 11 != 0, F.pmod(k * 13, F.lit(60)).cast("double")).alias("line_km"), F.when(k % 13 != 0, F.pmod(k * 29, F.lit(100)).cast("double")).alias("sub_km"),
    )


SITES_SQL = """SELECT s_suppkey AS site, 4.0::DOUBLE + (s_suppkey * 37 % 500) / 100.0::DOUBLE AS speed,
  CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey * 13 % 60)::DOUBLE END AS line_km, CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey * 29 % 100)::DOUBLE END AS sub_km FROM supplier"""


def scored(df: DataFrame) -> DataFrame:
    with_cuf = df.withColumn("cuf", wind.cuf(F.col("speed")))
    both = with_cuf.withColumns({"resource": wind.resource_score(F.col("cuf")), "grid": wind.grid_score(F.col("line_km"), F.col("sub_km"))})
    return both.withColumn("score", wind.site_score(F.col("resource"), F.col("grid")))


def screening_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite score, rating and rank of every site."""
    rows = global_rank(scored(sites(spark, sf_dir)), "score", "site")
    return rows.select("site", half_up(F.col("cuf"), 6).alias("cuf"), half_up(F.col("resource"), 6).alias("resource"), half_up(F.col("grid"), 6).alias("grid"), "score", wind.rating(F.col("score")).alias("rating"), "rank")


SCORED_SQL = f"""SELECT *, CAST(floor(72.0::DOUBLE * resource + 28.0::DOUBLE * grid + 0.5) AS INT) AS score FROM (
  SELECT *, {sql_piecewise('cuf', wind.RESOURCE_ANCHORS)} AS resource,
    0.6::DOUBLE * CASE WHEN line_km IS NULL THEN 0.15::DOUBLE ELSE least(1, greatest(0, 1.0::DOUBLE - (line_km - 2) / 38)) END
    + 0.4::DOUBLE * CASE WHEN sub_km IS NULL THEN 0.15::DOUBLE ELSE least(1, greatest(0, 1.0::DOUBLE - (sub_km - 5) / 75)) END AS grid
  FROM (SELECT *, {sql_piecewise('speed', wind.CUF_CURVE)} AS cuf FROM ({SITES_SQL})))"""

SCREEN_SQL = f"""
SELECT site, floor(cuf * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS cuf, floor(resource * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS resource, floor(grid * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS grid, score,
  CASE WHEN score >= 75 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 45 THEN 'Moderate' WHEN score >= 30 THEN 'Marginal' ELSE 'Poor' END AS rating,
  CAST(row_number() OVER (ORDER BY score DESC, site) AS INT) AS rank FROM ({SCORED_SQL})
"""


def shear_fit_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind shear exponent: slope of log speed over log height at all three heights, held to [0, 0.6]; 1/7 where one of them has no positive speed."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), (F.pmod("l_linenumber", F.lit(3)) * 50 + 50).cast("double").alias("height"), F.col("l_quantity").alias("q"))
    rows = rows.withColumn("v", (F.lit(4.0) + F.col("q") / F.lit(25.0)) * F.pow(F.col("height") / F.lit(100.0), F.lit(0.2)))
    means = rows.groupBy("site", "height").agg(F.avg("v").alias("v"))
    fit = means.groupBy("site").agg(F.regr_slope(F.log("v"), F.log("height")).alias("slope"), F.min("v").alias("least"), F.count("*").alias("heights"))
    shear = F.when((F.col("least") > 0) & (F.col("heights") == 3), clamp(F.col("slope"), 0, 0.6)).otherwise(F.lit(1 / 7))
    return fit.select("site", "heights", half_up(shear, 6).alias("shear"))


SHEAR_SQL = """
WITH m AS (
  SELECT l_suppkey AS site, (l_linenumber % 3 * 50 + 50)::DOUBLE AS height, avg((4.0::DOUBLE + l_quantity / 25) * pow((l_linenumber % 3 * 50 + 50) / 100.0::DOUBLE, 0.2)) AS v
  FROM lineitem GROUP BY 1, 2
)
SELECT site, count(*) AS heights, floor(CASE WHEN min(v) > 0 AND count(*) = 3 THEN least(0.6::DOUBLE, greatest(0, regr_slope(ln(v), ln(height)))) ELSE 1 / 7.0::DOUBLE END * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS shear
FROM m GROUP BY site
"""


def air_density_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air density at a height and the power density corrected for it."""
    metres = (F.col("p_size") * 50).cast("double")
    rho = wind.air_density(metres)
    return table(spark, sf_dir, "part").select("p_partkey", half_up(rho, 5).alias("density"), half_up(F.col("p_retailprice") / 2 * rho / F.lit(wind.SEA_LEVEL_DENSITY), 3).alias("power"))


AIR_SQL = """
SELECT p_partkey, floor(rho * 1e5::DOUBLE + 0.5) / 1e5::DOUBLE AS density, floor(p_retailprice / 2 * rho / 1.225::DOUBLE * 1000 + 0.5) / 1000 AS power
FROM (SELECT *, 1.225::DOUBLE * pow(1 - 2.2558e-5::DOUBLE * p_size * 50, 5.256) AS rho FROM part)
"""


def powercurve_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity factors by turbine class: the Weibull density times the power curve, summed over speeds.

    The speeds are exploded per site from a sequence, so the sum stays in
    generated code and a site's 120 rows never leave its task before they are
    added up.
    """
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("site"), (F.lit(5.0) + F.pmod(k * 17, F.lit(50)) / F.lit(10.0)).alias("scale"), (F.lit(1.6) + F.pmod(k * 7, F.lit(9)) / F.lit(10.0)).alias("shape"),
        (wind.air_density(F.pmod(k * 31, F.lit(1500)).cast("double")) / F.lit(wind.SEA_LEVEL_DENSITY)).alias("ratio"),
    )
    steps = int(wind.SPEED_MAX / wind.SPEED_STEP)
    grid = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("v", (F.col("i") + F.lit(0.5)) * F.lit(wind.SPEED_STEP))
    pdf = wind.weibull_pdf(F.col("v"), F.col("scale"), F.col("shape"))
    moved = F.col("v") * F.pow(F.col("ratio"), F.lit(1 / 3))
    sums = grid.withColumns({"pdf": pdf, "moved": moved}).groupBy("site").agg(*[F.sum(F.col("pdf") * wind.power_share(F.col("moved"), c) * F.lit(wind.SPEED_STEP)).alias(n) for n, c in wind.POWER_CURVES.items()])
    net = clamp(F.col("iec3"), 0, 1) * F.lit(wind.net_share())
    s = wind.sigma()
    return sums.select("site", *[half_up(clamp(F.col(n), 0, 1), 6).alias(n) for n in wind.POWER_CURVES], half_up(net, 6).alias("net_p50"), half_up(net * F.lit(1 - wind.Z75 * s), 6).alias("net_p75"), half_up(net * F.lit(1 - wind.Z90 * s), 6).alias("net_p90"))


def _power_sql(v: str, curve: list) -> str:
    return f"CASE WHEN {v} < 3 OR {v} > 25 THEN 0.0::DOUBLE ELSE {sql_piecewise(v, [(float(a), float(b)) for a, b in curve])} END"


def _r(x: str, digits: int = 6) -> str:
    return f"floor({x} * 1e{digits}::DOUBLE + 0.5) / 1e{digits}::DOUBLE"


POWER_SQL = f"""
WITH s AS (
  SELECT s_suppkey AS site, 5.0::DOUBLE + (s_suppkey * 17 % 50) / 10.0::DOUBLE AS a, 1.6::DOUBLE + (s_suppkey * 7 % 9) / 10.0::DOUBLE AS k,
    pow(1 - 2.2558e-5::DOUBLE * (s_suppkey * 31 % 1500), 5.256) AS ratio FROM supplier
), g AS (
  SELECT site, k / a * pow(v / a, k - 1) * exp(-pow(v / a, k)) AS pdf, v * pow(ratio, 1 / 3.0::DOUBLE) AS m
  FROM (SELECT *, (i + 0.5::DOUBLE) * 0.25 AS v FROM s, range(120) AS t(i))
), c AS (
  SELECT site, {', '.join(f"sum(pdf * {_power_sql('m', c)} * 0.25) AS {n}" for n, c in wind.POWER_CURVES.items())} FROM g GROUP BY site
), n AS (
  SELECT site, {', '.join(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, {n})) AS {n}' for n in wind.POWER_CURVES)} FROM c
), w AS (
  SELECT *, iec3 * 0.9::DOUBLE * 0.96::DOUBLE * 0.975::DOUBLE * 0.98::DOUBLE * 0.98::DOUBLE AS net, sqrt(0.06 * 0.06 + 0.06 * 0.06 + 0.03 * 0.03 + 0.05 * 0.05)::DOUBLE AS s FROM n
)
SELECT site, {_r('iec1')} AS iec1, {_r('iec2')} AS iec2, {_r('iec3')} AS iec3, {_r('net')} AS net_p50, {_r('net * (1 - 0.674::DOUBLE * s)')} AS net_p75, {_r('net * (1 - 1.282::DOUBLE * s)')} AS net_p90 FROM w
"""


def developable_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a site left after exclusions and steep ground, its capacity and yearly energy."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), (F.pmod(k * 3, F.lit(40)) + 1).cast("double").alias("km2"), F.when(k % 7 != 0, F.pmod(k, F.lit(10)) / F.lit(20.0)).alias("excluded"), (F.pmod(k * 5, F.lit(8)) / F.lit(20.0)).alias("steep"), (F.lit(0.25) + F.pmod(k, F.lit(20)) / F.lit(100.0)).alias("cf"))
    share = (F.lit(1.0) - F.coalesce("excluded", F.lit(0.0))) * (F.lit(1.0) - F.col("steep")) * F.lit(0.85)
    with_mw = rows.withColumn("share", share).withColumn("mw", half_up(F.col("km2") * F.col("share") * 5, 1))
    return with_mw.select("site", "excluded", half_up(F.col("share"), 4).alias("share"), "mw", half_up(F.col("mw") * F.col("cf") * F.lit(8.76), 1).alias("gwh"))


SIZING_SQL = f"""
WITH s AS (
  SELECT s_suppkey AS site, (s_suppkey * 3 % 40 + 1)::DOUBLE AS km2, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 10) / 20.0::DOUBLE END AS excluded,
    (s_suppkey * 5 % 8) / 20.0::DOUBLE AS steep, 0.25::DOUBLE + (s_suppkey % 20) / 100.0::DOUBLE AS cf FROM supplier
), d AS (SELECT *, (1 - coalesce(excluded, 0)) * (1 - steep) * 0.85::DOUBLE AS share FROM s),
m AS (SELECT *, {_r('km2 * share * 5', 1)} AS mw FROM d)
SELECT site, excluded, {_r('share', 4)} AS share, mw, {_r('mw * cf * 8.76::DOUBLE', 1)} AS gwh FROM m
"""


def weibull_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of each site's wind speed at 81 points up to 20 m/s."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("site"), (F.lit(6.0) + F.pmod(k, F.lit(5))).alias("scale"), (F.lit(1.8) + F.pmod(k, F.lit(4)) / F.lit(10.0)).alias("shape"), F.explode(F.sequence(F.lit(0), F.lit(80))).alias("i"))
    v = F.col("i") / F.lit(4.0)
    return rows.select("site", v.alias("v"), half_up(F.when(v > 0, wind.weibull_pdf(v, F.col("scale"), F.col("shape"))).otherwise(0.0), 7).alias("density"))


WEIBULL_SQL = f"""
SELECT site, v, {_r("CASE WHEN v > 0 THEN k / a * pow(v / a, k - 1) * exp(-pow(v / a, k)) ELSE 0.0::DOUBLE END", 7)} AS density
FROM (SELECT s_suppkey AS site, 6.0::DOUBLE + s_suppkey % 5 AS a, 1.8::DOUBLE + (s_suppkey % 4) / 10.0::DOUBLE AS k, i / 4.0::DOUBLE AS v FROM supplier, range(81) AS t(i))
"""

QUERIES = {f.__name__: f for f in (zonal_wind_stats, screening_score_rank, shear_fit_by_site, air_density_power, powercurve_cf, developable_sizing, weibull_curve)}
SQL = {"zonal_wind_stats": ZONAL_SQL, "screening_score_rank": SCREEN_SQL, "shear_fit_by_site": SHEAR_SQL, "air_density_power": AIR_SQL, "powercurve_cf": POWER_SQL, "developable_sizing": SIZING_SQL, "weibull_curve": WEIBULL_SQL}
