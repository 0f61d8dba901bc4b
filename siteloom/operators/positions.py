"""Exact positions and running sums over a whole table, without one task seeing it all.

The rows are range-partitioned and sorted, each task numbers its own rows and
keeps its own running sum, and the totals of the tasks, a row for each task
and group, are summed up and joined back. The numbered rows are staged in
between, so that the totals and the rows come from the same partitioning even
if a task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siteloom.operators.staging import staged


def ranked(df: DataFrame, group: str | None, order: list[str | Column], amount: str) -> DataFrame:
    """``df`` with ``position`` (from 0) and ``before`` (sum of whole-number ``amount`` of earlier rows) in its group.

    ``group`` names a column without nulls, a number or a string, or is None
    for one group of all rows. ``order`` should fix the order fully; rows equal
    in it are identical to the result and get distinct positions. The slim
    columns that ``df`` holds are all staged, so give it no text.
    """
    keyed = df if group else df.withColumn("all_rows", F.lit(0).cast("long"))
    group = group or "all_rows"
    parts = keyed.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id().cast("long"))
    fields = [*parts.schema.fields, T.StructField("position", T.LongType()), T.StructField("before", T.LongType())]
    schema = T.StructType(fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(group).dictionary_encode()
            key, value = np.asarray(coded.indices), batch.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([coded[0].as_py() != last], key[1:] != key[:-1])))
            run = np.searchsorted(starts, np.arange(len(key)), side="right") - 1
            sums = np.concatenate(([0], np.cumsum(value)))
            at = np.where(run >= 0, np.arange(len(key)) - starts[run] if len(starts) else 0, np.arange(len(key)) + count)
            pre = np.where(run >= 0, sums[:-1] - sums[starts[run]] if len(starts) else 0, sums[:-1] + total)
            last, count, total = coded[len(key) - 1].as_py(), int(at[-1]) + 1, int(pre[-1] + value[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(pre, pa.int64())], schema=pa.schema([*zip(batch.schema.names, batch.schema.types), ("position", pa.int64()), ("before", pa.int64())]))

    numbered = staged(parts.mapInArrow(number, schema))
    totals = numbered.groupBy(group, "part").agg(F.count("*").alias("rows"), F.sum(amount).alias("sum"))
    # A row for each task and each group in it: as many rows as tasks, plus groups.
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(group, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_before"))
    out = numbered.join(shift, [group, "part"]).withColumn("position", F.col("position") + F.col("rows_before")).withColumn("before", F.col("before") + F.col("sum_before"))
    out = out.drop("rows_before", "sum_before", "part", "all_rows")
    out._staged_at = numbered._staged_at
    return out
