"""Tables written into the folder that the driver and all executors share.

A staged table cuts the lineage: what follows reads files, so a lost executor
costs only the tasks it ran, and the optimizer sees the size of the files
instead of an estimate multiplied at every join.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_steps: list[list[DataFrame]] = []  # what the steps that run have staged so far


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siteloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Writes within it drop their shuffle files as soon as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    The shuffle files of that write go as soon as it ends, so that the disk in
    use is that of one step and not of all steps so far.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteloom/{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in _steps:
        made.append(out)
    return out


def staged_alone(step: Callable[[], DataFrame]) -> DataFrame:
    """What ``step`` gives, staged; all else that it staged on the way goes."""
    made: list[DataFrame] = []
    _steps.append(made)
    try:
        out = staged(step())
    finally:
        _steps.pop()
    drop_staged(*(df for df in made if df is not out))
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
