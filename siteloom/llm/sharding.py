"""Contiguous shards of equal bytes from global prefix sums.

Documents stand in the order of their id. Each task sums the sizes of its own
sorted range, the tasks' totals give every document the bytes before it, and
the middle of a document decides its shard: the shards are cut at equal shares
of all bytes, so two shards differ by a document's size at most.

A size is the text's UTF-8 bytes plus ``EXTRA``; null texts count as none.
Rows with equal ids stand in the order of their text's checksum and length;
repeated rows get distinct slots. Null ids come first. With fewer documents
than shards some shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import drop_staged, staged
from siteloom.llm.ranks import ranked

SHARDS = 24
EXTRA = 8


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (id, size, text_crc32 and more) with their shard and slot."""
    placed = ranked(rows, None, [F.col("id"), F.col("text_crc32"), F.col("size")], "size")
    total = placed.agg(F.sum("size")).first()[0] or 1
    # Twice the middle of the document against twice the total, in whole numbers.
    middle = (F.col("before").cast("decimal(38,0)") * 2 + F.col("size")) * n_shards
    dealt = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / (F.lit(total).cast("decimal(38,0)") * 2)).cast("int")))
    dealt = staged(dealt.select(*rows.columns, "shard", "position"))
    drop_staged(placed)
    first = dealt.groupBy("shard").agg(F.min("position").alias("first"))  # a row for each shard
    return dealt.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("position") - F.col("first")).alias("slot"))


def _measures(id_column: str, text: str, extra: int) -> list[Column]:
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.col(id_column).alias("id"), (F.octet_length(value) + F.lit(extra)).cast("long").alias("size"), F.crc32(value.cast("binary")).cast("long").alias("text_crc32")]


def shards(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n_shards: int = SHARDS, extra: int = EXTRA) -> DataFrame:
    """id, size, text_crc32, shard and slot (from 0 in each shard) of every document."""
    return _placed(docs.select(*_measures(id_column, text, extra)), n_shards).withColumnRenamed("id", id_column)


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", n_shards: int = SHARDS) -> None:
    """Write whole documents below ``path``, a folder for each shard, each in slot order within its files.

    Whole rows are ranked, and so staged on the way: repeated rows have nothing that would tell them apart in a join.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_measures(id_column, text, EXTRA))
    placed = _placed(rows, n_shards)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    placed.select(*own, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
