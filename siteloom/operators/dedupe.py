"""Keeping one row per key: first by priority, latest version, overlays."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key; the order should have no ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("kept_rank", rank).where("kept_rank = 1").drop("kept_rank")


def latest(df: DataFrame, keys: list[str], version: str, tie: str, upto: int | None = None) -> DataFrame:
    """The newest version of each key, of those up to ``upto`` if given; ties go to the smallest ``tie``."""
    seen = df if upto is None else df.where(F.col(version) <= upto)
    return keep_first(seen, keys, [F.col(version).desc(), F.col(tie)])


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Both tables' rows by key; where both have a value, that of ``over``."""
    b, o = base.alias("b"), over.alias("o")
    picked = [F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) for c in columns]
    return b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"b.{key}").alias(key), *picked)


def last_by(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key, nulls being a key too: the last by ``order``, then by all columns that have one.

    A maximum by key, so that tasks take it of their own rows first.
    """
    rest = [f.name for f in df.schema if f.name not in {*keys, *(order or [])} and "map<" not in f.dataType.simpleString()]
    rank = F.struct(*[F.col(c) for c in [*(order or []), *rest]], F.lit(0).alias("none_"))
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("row_"))
    return found.select(*[F.col("row_")[c].alias(c) for c in df.columns])


def lacking(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key ``others`` lacks; a null key equals a null key."""
    known = others.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).distinct()
    same = [df[k].eqNullSafe(known[f"key_{i}"]) for i, k in enumerate(keys)]
    return df.join(known, reduce(and_, same), "left_anti")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` put in by key; of several changes of a key the last by ``order``, then by their columns."""
    return lacking(current, changes, keys).unionByName(last_by(changes, keys, order))


def insert_absent(current: DataFrame, candidates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``current`` and those candidates whose key it lacks, one a key, chosen likewise."""
    return current.unionByName(last_by(lacking(candidates, current, keys), keys, order))
