"""Writers: upserts, replacement by partition, archives, cached results, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.operators.dedupe import insert_absent, upsert


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _move(fs, source, target) -> None:
    """A rename that raises if it did not happen; file systems only say so."""
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def recover(spark: SparkSession, path: str) -> None:
    """Bring back a table that a replacement left under its spare name when it broke off."""
    fs, make = _files(spark, path)
    if not fs.exists(make(path)) and fs.exists(make(path + ".old")):
        _move(fs, make(path + ".old"), make(path))


def _swap(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: the new one is whole before the old one is moved, and in place before that one goes."""
    recover(df.sparkSession, path)
    df.write.mode("overwrite").parquet(path + ".new")
    fs, make = _files(df.sparkSession, path)
    at, fresh, old = make(path), make(path + ".new"), make(path + ".old")
    if fs.exists(at):
        fs.delete(old, True)  # of an earlier replacement that was all but done
        _move(fs, at, old)
    try:
        _move(fs, fresh, at)
    except Exception:
        recover(df.sparkSession, path)
        raise
    fs.delete(old, True)


def replace_all(df: DataFrame, path: str) -> None:
    """Full replacement."""
    _swap(df, path)


def upsert_table(changes: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Rows of ``changes`` put into the table by key; of several of a key the last by ``order``."""
    recover(changes.sparkSession, path)
    current = changes.sparkSession.read.schema(changes.schema).parquet(path)
    _swap(upsert(current, changes, keys, order), path)


def insert_table(candidates: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Rows whose key the table lacks."""
    recover(candidates.sparkSession, path)
    current = candidates.sparkSession.read.schema(candidates.schema).parquet(path)
    _swap(insert_absent(current, candidates, keys, order), path)


def replace_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    """Replace just the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def archive(df: DataFrame, path: str, run_date: str) -> None:
    """Keep a run's rows under its date, replacing an earlier run of the same date."""
    replace_partitions(df.withColumn("run_date", F.lit(run_date)), path, ["run_date"])


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest run; only its partition is read."""
    runs = spark.read.parquet(path)
    newest = runs.agg(F.max("run_date")).first()[0]
    return runs.where(F.col("run_date") == newest).drop("run_date")


def cache_misses(requests: DataFrame, cached: DataFrame, payload: str, version: str) -> DataFrame:
    """Requests with their cache key, of which no result is cached."""
    keyed = requests.withColumn("cache_key", F.md5(F.concat_ws("|", payload, F.lit(version)).cast("binary")))
    return keyed.join(cached.select("cache_key"), "cache_key", "left_anti")


def within_cap(saved: DataFrame, cap: int = 3) -> DataFrame:
    """Each user's first ``cap`` saved sites by time, then id."""
    order = W.partitionBy("user_id").orderBy("created_at", "id")
    return saved.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a field are doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def geojson_points(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One line of GeoJSON per row, with coordinates to five places."""
    at = F.array(F.round(lon, 5), F.round(lat, 5))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))
