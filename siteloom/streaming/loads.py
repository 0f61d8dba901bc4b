"""Incremental loads that may be run twice: each batch of a stream is a set of changes under its own number.

A batch writes its changes, one row a key, whole and under its number; a run
that is repeated writes the same rows to the same place, and what a run left
half-written has no mark of success and is not read. The table is, for each
key, the row of the last batch that has it. ``compact`` folds batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.operators.dedupe import last_by

BATCH = "load_batch"


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the batches below ``path`` that were written whole, compacted ones taken for what they hold."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    whole = [n for n in names if n.partition("-")[0] in ("batch", "upto") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    upto = max((int(n[5:]) for n in whole if n.startswith("upto-")), default=-1)
    return sorted([(int(n[6:]), f"{path}/{n}") for n in whole if n.startswith("batch-") and int(n[6:]) > upto] + ([(upto, f"{path}/upto-{upto}")] if upto >= 0 else []))


def put(changes: DataFrame, batch: int, path: str, keys: list[str], order: list[str]) -> None:
    """Write a batch's changes: of each key the last row by ``order``."""
    last_by(changes, keys, order).withColumn(BATCH, F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{batch}")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table: of each key the row of the last batch that has it."""
    folders = _folders(spark, path)
    if not folders:
        raise FileNotFoundError(f"no batch has been loaded to {path}")
    return last_by(spark.read.parquet(*[f for _, f in folders]), keys, [BATCH]).drop(BATCH)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold all batches so far into one folder; the others go when it is whole."""
    folders = _folders(spark, path)
    if len(folders) < 2:
        return
    last = folders[-1][0]
    last_by(spark.read.parquet(*[f for _, f in folders]), keys, [BATCH]).write.mode("overwrite").parquet(f"{path}/upto-{last}")
    jvm = spark._jvm
    for _, folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if folder != f"{path}/upto-{last}":
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def load(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Load all that ``stream`` has now and end: what a scheduler calls once a day, or as often as it likes."""

    def step(batch: DataFrame, number: int) -> None:
        put(batch, number, path, keys, order)
        if after:
            after(batch, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
