"""Hourly series and usage queries on the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions.numeric import half_up
from siteloom.plans.tables import table


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wind samples: speed, and a direction every tenth of which is unknown."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "ts", F.col("value").alias("speed"), F.when(k % 10 != 0, F.pmod(k * 37, F.lit(3600)) / F.lit(10.0)).alias("direction"))


SAMPLES = "SELECT user_id AS site, ts, value AS speed, CASE WHEN event_id % 10 <> 0 THEN (event_id * 37 % 3600) / 10.0::DOUBLE END AS direction FROM events"


def sector(direction: Column) -> Column:
    """One of 16 compass sectors; half a sector either side of north is sector 0."""
    return F.pmod(F.floor(direction / F.lit(22.5) + F.lit(0.5)), F.lit(16)).cast("int")


def wind_rose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and mean speed of each of the 16 sectors; all sectors are present."""
    rows = _samples(spark, sf_dir).where("direction IS NOT NULL AND speed IS NOT NULL")
    found = rows.groupBy(sector(F.col("direction")).alias("sector")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean"))
    total = F.sum("n").over(W.partitionBy())  # over 16 rows
    every = spark.range(16).select(F.col("id").cast("int").alias("sector"))
    shares = found.withColumn("share", F.col("n") * 100 / total)
    return every.join(F.broadcast(shares), "sector", "left").select("sector", half_up(F.coalesce("share", F.lit(0.0)), 1).alias("percent"), half_up(F.coalesce("mean", F.lit(0.0)), 2).alias("mean"))


ROSE_SQL = f"""
WITH s AS (SELECT CAST(floor(direction / 22.5 + 0.5) AS INT) % 16 AS sector, speed FROM ({SAMPLES}) WHERE direction IS NOT NULL AND speed IS NOT NULL),
g AS (SELECT sector, count(*) AS n, avg(speed) AS mean FROM s GROUP BY 1)
SELECT CAST(i AS INT) AS sector, floor(coalesce(n * 100.0::DOUBLE / (SELECT count(*) FROM s), 0) * 10 + 0.5) / 10 AS percent, floor(coalesce(mean, 0) * 100 + 0.5) / 100 AS mean
FROM range(16) AS t(i) LEFT JOIN g ON g.sector = i
"""


def _slots(spark: SparkSession, sf_dir: str, slot: Column, first: int, count: int) -> DataFrame:
    means = _samples(spark, sf_dir).groupBy(slot.alias("slot")).agg(F.avg("speed").alias("mean"))
    every = spark.range(first, first + count).select(F.col("id").cast("int").alias("slot"))
    return every.join(F.broadcast(means), "slot", "left").select("slot", half_up(F.coalesce("mean", F.lit(0.0)), 3).alias("mean"))


def monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speed of each calendar month; months without samples are 0."""
    return _slots(spark, sf_dir, F.month("ts"), 1, 12)


def diurnal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speed of each hour of the day."""
    return _slots(spark, sf_dir, F.hour("ts"), 0, 24)


def _slots_sql(part: str, first: int, count: int) -> str:
    return f"SELECT CAST(i AS INT) AS slot, floor(coalesce(m, 0) * 1000 + 0.5) / 1000 AS mean FROM range({first}, {first + count}) AS t(i) LEFT JOIN (SELECT {part}(ts) AS slot, avg(value) AS m FROM events GROUP BY 1) ON slot = i"


def metrics_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank median, 95th percentile and maximum of the last 512 values of each type."""
    last = W.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value").withColumn("n", F.row_number().over(last)).where("n <= 512")
    return rows.groupBy("event_type").agg(F.count("*").alias("samples"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"))


RANK_SQL = """
SELECT event_type, count(*) AS samples, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 512 GROUP BY event_type
"""


def usage_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users of each day and type, with the change from the day before."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return days.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("event_type").orderBy("day")))


USAGE_SQL = """
SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM (
  SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)
"""


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days with more requests than the limit of 4, in fixed windows."""
    day = F.to_date("ts").cast("string").alias("day")
    return table(spark, sf_dir, "events").groupBy("user_id", day).agg(F.count("*").alias("requests")).where("requests > 4").withColumn("rejected", F.col("requests") - 4)


RATE_SQL = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, count(*) - 4 AS rejected FROM events GROUP BY 1, 2 HAVING count(*) > 4"


def hourly_site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first, last and mean speed and the longest gap between samples, in seconds."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(order), F.col("ts")))
    return rows.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), half_up(F.avg("value"), 3).alias("mean"), F.max("gap").alias("longest_gap"))


SERIES_SQL = """
SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, floor(avg(value) * 1000 + 0.5) / 1000 AS mean, max(gap) AS longest_gap
FROM (SELECT *, CAST((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS BIGINT) AS gap FROM events) GROUP BY user_id
"""

QUERIES = {f.__name__: f for f in (wind_rose, monthly_means, diurnal_means, metrics_nearest_rank, usage_analytics, rate_limit_windows, hourly_site_series)}
SQL = {"wind_rose": ROSE_SQL, "monthly_means": _slots_sql("month", 1, 12), "diurnal_means": _slots_sql("hour", 0, 24), "metrics_nearest_rank": RANK_SQL, "usage_analytics": USAGE_SQL, "rate_limit_windows": RATE_SQL, "hourly_site_series": SERIES_SQL}
