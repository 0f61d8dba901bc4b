"""An archive of tiles for random reads: payloads once each, and two levels of directories over Hilbert-ordered tile ids.

Ids run over zoom levels one after another and along a Hilbert curve within
one, so tiles that are neighbours lie together. Equal payloads are stored
once. A directory entry is a run of ids that share a payload; entries fall into
leaves by the high bits of their id, and the root lists the leaves. A read
goes from ids to leaves to the places of payloads, each a join on a key by
which the files are partitioned, so only the files that hold what was asked for
are opened.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.operators.positions import ranked
from siteloom.operators.ranking import if_small
from siteloom.operators.staging import staged

LEAF_BITS = 12  # ids of a leaf
FOLDER_LEAVES = 64  # leaves of a folder
PART_BYTES = 64 << 20  # payload bytes of a folder
NAMED = 1000  # folders that a read names at most


@F.pandas_udf(T.LongType())
def tile_id(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """The place of a tile among all tiles: those of lower zooms first, then along the curve."""
    zoom, u, v = z.to_numpy(np.int64), x.to_numpy(np.int64).copy(), y.to_numpy(np.int64).copy()
    out = ((1 << 2 * zoom) - 1) // 3
    for bit in range(int(zoom.max()) - 1 if len(zoom) else -1, -1, -1):
        live, s = bit < zoom, np.int64(1) << bit
        right, low = (u & s) > 0, (v & s) > 0
        out += np.where(live, s * s * np.where(right, np.where(low, 2, 3), np.where(low, 1, 0)), 0)
        turn = live & ~low
        mirror = turn & right
        u, v = np.where(mirror, s - 1 - (u & (s - 1)), u & (s - 1)), np.where(mirror, s - 1 - (v & (s - 1)), v & (s - 1))
        u, v = np.where(turn, v, u), np.where(turn, u, v)
    return pd.Series(out)


def _leaf(identity: Column) -> Column:
    return F.shiftright(identity, LEAF_BITS)


def write_archive(tiles: DataFrame, path: str) -> None:
    """Store ``tiles`` (z, x, y, data), each at most once, below ``path``."""
    keyed = staged(tiles.where(F.col("data").isNotNull()).select(tile_id("z", "x", "y").alias("id"), "data", F.sha2("data", 256).alias("digest")))
    once = staged(keyed.groupBy("digest").agg(F.min("id").alias("first"), F.first("data").alias("data"), F.max(F.octet_length("data")).cast("long").alias("length")))
    placed = ranked(once.select("digest", "first", "length"), None, ["first", "digest"], "length").select("digest", "length", F.col("before").alias("offset"))
    placed = staged(placed)
    part = F.floor(F.col("offset") / PART_BYTES).cast("int")
    payloads = once.drop("length").join(placed, "digest").select("offset", "length", "data", part.alias("part"))
    payloads.repartitionByRange("part", "offset").sortWithinPartitions("part", "offset").write.mode("overwrite").partitionBy("part").parquet(f"{path}/payloads")
    entries = keyed.select("id", "digest").join(placed, "digest").select("id", "offset", "length", F.lit(0).cast("long").alias("none"))
    # Runs: among the ids of a payload, those in a row are as far from their place as each other.
    numbered = ranked(entries, "offset", ["id"], "none")
    runs = numbered.groupBy(_leaf(F.col("id")).alias("leaf"), "offset", (F.col("id") - F.col("position")).alias("run")).agg(F.min("id").alias("first"), F.count("*").alias("ids"), F.max("length").alias("length"))
    leaves = runs.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("first", "ids", "offset", "length"))).alias("entries"))  # at most 2^LEAF_BITS entries
    leaves = staged(leaves.withColumn("folder", F.floor(F.col("leaf") / FOLDER_LEAVES).cast("int")))
    leaves.repartitionByRange("folder", "leaf").sortWithinPartitions("folder", "leaf").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/leaves")
    leaves.groupBy("folder").agg(F.min("leaf").alias("first_leaf"), F.count("*").alias("leaves"), F.sum(F.size("entries")).alias("entries")).coalesce(1).write.mode("overwrite").parquet(f"{path}/root")


def _folders(stored: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``stored`` without the folders that ``wanted`` has no row for, where those it has can be named in a filter; the join that follows is right either way."""
    some = [r[0] for r in wanted.select(column).distinct().limit(NAMED + 1).collect()]
    return stored.where(F.col(column).isin(some)) if len(some) <= NAMED else stored


def locate(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """``asked`` (z, x, y) that the archive has, with offset, length and part of their payloads."""
    root = spark.read.parquet(f"{path}/root").select("folder")
    keyed = asked.select("z", "x", "y").distinct().withColumn("id", tile_id("z", "x", "y")).withColumn("leaf", _leaf(F.col("id"))).withColumn("folder", F.floor(F.col("leaf") / FOLDER_LEAVES).cast("int"))
    known = staged(keyed.join(if_small(root), "folder", "left_semi"))
    leaves = spark.read.parquet(f"{path}/leaves")
    wanted = if_small(known.select("folder", "leaf").distinct())
    entries = _folders(leaves, "folder", known).join(wanted, ["folder", "leaf"]).select("leaf", F.explode("entries").alias("e")).select("leaf", "e.*")
    met = known.join(entries, "leaf").where((F.col("id") >= F.col("first")) & (F.col("id") < F.col("first") + F.col("ids")))
    return met.select("z", "x", "y", "offset", "length", F.floor(F.col("offset") / PART_BYTES).cast("int").alias("part"))


def read_tiles(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """z, x, y and data of the tiles ``asked`` for that the archive has."""
    found = staged(locate(spark, path, asked))
    payloads = spark.read.parquet(f"{path}/payloads")
    places = if_small(found.select("part", "offset").distinct())
    return _folders(payloads, "part", found).join(places, ["part", "offset"]).select("offset", "data").join(found, "offset").select("z", "x", "y", "data")
