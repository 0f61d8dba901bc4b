"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.staging import drop_staged, staged


def components(spark: SparkSession, edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternating large-star and small-star rounds over (bigger, smaller) edges.
    Each round finds every node's smallest neighbour by a pre-aggregated
    minimum and joins it back, so a node with a million links is a join key
    that Spark can split and never a group held by one task. Rounds end when
    the edges stop changing; each round's edges are staged.
    """
    start = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    now = staged(start)
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Every neighbour above u goes to the least of u and its neighbours.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        after = staged(small)
        drop_staged(now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    out = roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    out._staged_at = now._staged_at
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every row of ``nodes``, those without an edge (a, b) included."""
    found = components(nodes.sparkSession, edges, "a", "b").withColumnRenamed("node", "linked")
    return nodes.join(found, nodes["node"] == found["linked"], "left").select("node", F.coalesce("root", "node").alias("root"))
