"""Ranks over a whole table, and broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.operators.positions import ranked


def global_rank(df: DataFrame, score: str, key: str, width: int = 1 << 20) -> DataFrame:
    """``df`` with ``rank``: its place by falling ``score`` of few distinct values, ties by rising whole-number ``key``.

    Rows are numbered within a score and a stretch of ``width`` keys; the
    counts of those groups, a small table, are summed up and joined back. No
    task sees more than one group, so the rank holds at any size.
    """
    dealt = df.withColumn("stretch", F.floor(F.col(key) / width))
    groups = dealt.groupBy(score, "stretch").agg(F.count("*").alias("rows"))
    earlier = W.orderBy(F.col(score).desc_nulls_last(), "stretch").rowsBetween(W.unboundedPreceding, -1)
    before = groups.select(F.col(score).alias("of_score"), F.col("stretch").alias("of_stretch"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    met = dealt.join(before, dealt[score].eqNullSafe(before["of_score"]) & (dealt["stretch"] == before["of_stretch"]))
    place = F.row_number().over(W.partitionBy(score, "stretch").orderBy(key))
    return met.withColumn("rank", (F.col("before") + place).cast("int")).select(*df.columns, "rank")


def if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """share and ``value`` at each of ``shares``, exact, on a straight line between the two values around its place; for each ``by`` if given; nulls don't count.

    Equal values are counted first, and the counts get their place among all
    values, or those of their group, by ranges of values that tasks sort on
    their own. So neither an outlier nor a large group gathers in one task.
    """
    of = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")) if by else F.lit("")
    named = [F.first(by).alias(by)] if by else []
    rows = df.where(F.col(value).isNotNull()).withColumn("of_", of)
    counted = rows.groupBy("of_", F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"), *named)
    placed = ranked(counted, "of_", ["v"], "n")
    totals = placed.groupBy("of_").agg(F.sum("n").alias("all"), *named)
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    places = totals.select("*", at).withColumn("place", F.col("share") * (F.col("all") - 1))
    wanted = places.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("index", F.when(F.col("side") == 0, F.floor("place")).otherwise(F.ceil("place")))
    held = placed.select(F.col("of_").alias("held_"), "v", "n", "before")
    met = held.join(if_small(wanted), F.col("held_") == F.col("of_")).where((F.col("index") >= F.col("before")) & (F.col("index") < F.col("before") + F.col("n")))
    keys = [*([by] if by else []), "share"]
    pair = met.groupBy("of_", "share", "place").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"), *named)
    return pair.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias(value))
