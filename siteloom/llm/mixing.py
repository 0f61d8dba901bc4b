"""Mixing sources to target weights by systematic sampling.

A source's target is its share of ``BUDGET`` times all words; targets stop at
``MOST`` times the source's words and the excess is shared out again. Each of
a source's documents is then expected ``target / source words`` times. The
documents of a source stand in order of size, their expected copies are
summed up, one random offset per source is added, and a document is emitted
once for each whole number its step crosses. The order by size spreads the
copies over all sizes, so that the words taken come near the target.

Null and empty texts have size 0 and add no words. A null source is a source
of its own, the last. Repeated rows count one by one. A source of size 0 has
target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.llm.common import WORD, drop_staged, staged
from siteloom.llm.ranks import ranked

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "siteloom-mix-1"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the seed and the source decide."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, source_rank, target: one row per source.

    With sources in the order of ``most * size / weight``, those up to some
    place are held at their cap and the rest share what is left by weight. The
    table has a row for each source, so its windows see only those.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("source_rank", F.row_number().over(by_name).cast("long")).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = W.orderBy("ratio", "source_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_of = W.partitionBy()
    rows = rows.select("*", F.sum("cap").over(upto).alias("capped"), F.sum("weight").over(upto).alias("capped_weight"), F.sum("source_size").over(all_of).alias("words"), F.sum("weight").over(all_of).alias("all_weight"))
    level = (F.lit(budget) * F.col("words") - (F.col("capped") - F.col("cap"))) / (F.col("all_weight") - (F.col("capped_weight") - F.col("weight")))
    # The share a unit of weight gets if this source is the first that is not held at its cap.
    rows = rows.withColumn("level", F.when(F.col("ratio") >= level, level))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(W.orderBy("ratio", "source_rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", "source_rank", target.alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """id, source, size, source_size, target and copies of every row; ``text_hash`` tells rows of one id apart."""
    slim = staged(docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(text)).alias("text_hash")))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most).withColumnRenamed("source", "named")
    with_plan = slim.join(plan, slim["source"].eqNullSafe(plan["named"])).drop("named")
    placed = ranked(with_plan, "source_rank", [F.col("size").desc(), F.col("id"), F.col("text_hash")], "size")
    drop_staged(slim)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.floor(F.col("position") * rate + offset(F.col("source"), seed))
    end = F.floor((F.col("position") + 1) * rate + offset(F.col("source"), seed))
    return placed.select("id", "text_hash", "source", "size", "source_size", "target", (end - start).cast("long").alias("copies")).withColumnRenamed("id", id_column)


def emit(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``mixed`` says.

    Rows alike in id and text share their copies evenly, and what is left over
    goes to one of them.
    """
    each = mixed.groupBy(F.col(id_column).alias("id"), "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_column).alias("row_id"), F.xxhash64(F.col(text)).alias("row_hash"))
    joined = rows.join(each, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")))
    times = lambda n: F.explode(F.array_repeat(F.lit(1), n.cast("int")))
    whole = joined.select("row", times(F.floor(F.col("copies") / F.col("alike"))).alias("copy"))
    rest = joined.where((F.col("alike") > 1) & (F.col("copies") % F.col("alike") > 0)).dropDuplicates(["row_id", "row_hash"])
    rest = rest.select("row", times(F.col("copies") % F.col("alike")).alias("copy"))
    return whole.unionByName(rest).select("row.*")
