"""Streams over a folder of files, run to their end, against the batch result."""

import pytest
from pyspark.sql import functions as F

from siteloom.streaming import windows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("ts"), F.pmod("id", F.lit(4)).alias("user_id"), F.concat(F.lit("t"), F.pmod("id", F.lit(3))).alias("event_type"), (F.pmod(F.col("id") * 31, F.lit(97)) / 2).alias("value"))
    rows.repartition(3).write.mode("overwrite").parquet(path)
    return path


def run(spark, df, mode, tmp_path, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_over_limit(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    stream = windows.over_limit(spark.readStream.schema(schema).parquet(folder), 2, lateness="1 day")
    got = {(r["user_id"], r["start"], r["requests"]) for r in run(spark, stream, "complete", tmp_path, "limits").collect()}
    batch = windows.over_limit(spark.read.parquet(folder), 2)
    assert got == {(r["user_id"], r["start"], r["requests"]) for r in batch.collect()} and got


def test_once(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    stream = windows.once(spark.readStream.schema(schema).parquet(folder), "user_id", "1 day")
    assert run(spark, stream, "append", tmp_path, "seen").count() == 4


def test_last_samples(spark, folder, tmp_path):
    schema = spark.read.parquet(folder).schema
    stream = windows.last_samples(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder), 20)
    got = {r["event_type"]: (r["samples"], r["p50"], r["p95"], r["most"]) for r in run(spark, stream, "update", tmp_path, "samples").collect()}
    rows = spark.read.parquet(folder).toPandas().sort_values("ts")
    for kind, own in rows.groupby("event_type"):
        last = sorted(own["value"].tail(20))
        assert got[kind] == (20, last[9], last[18], last[19])


def test_stale(spark):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-05 00:00:00")], "event_type string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r["event_type"] for r in windows.stale_sources(events).collect()] == ["a"]
