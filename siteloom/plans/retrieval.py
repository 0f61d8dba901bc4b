"""Vector retrieval, sibling expansion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteloom.functions.numeric import half_up
from siteloom.operators.search import holding
from siteloom.operators.vectors import best_by_cosine
from siteloom.plans.tables import table

TOP = 10


def vector_topk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vectors for every query, those whose id is divisible by 50, merged by their best score."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where("vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")
    met = best_by_cosine(vectors, vectors.where("id % 50 = 0"), TOP)
    best = met.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))).where(F.col("n") <= TOP)
    return best.groupBy(F.col("id").alias("vec_id")).agg(half_up(F.max("score"), 6).alias("score"), F.count("*").alias("queries"))


TOPK_SQL = """
WITH s AS (SELECT q.vec_id AS query, v.vec_id, floor(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT vec_id, floor(max(score) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS score, count(*) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10 GROUP BY vec_id
"""


def sibling_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 longest documents as hits, and up to 32 others of the same source and language as siblings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    hits = docs.orderBy(F.col("n_chars").desc(), "doc_id").limit(20)
    groups = hits.select("source", "lang").distinct()
    others = docs.join(F.broadcast(groups), ["source", "lang"], "left_semi").join(F.broadcast(hits.select("doc_id")), "doc_id", "left_anti")
    place = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))
    siblings = others.withColumn("n", place).where("n <= 32")
    return hits.select("doc_id", F.lit("hit").alias("kind"), F.col("n_chars").alias("score")).unionByName(siblings.select("doc_id", F.lit("sibling").alias("kind"), F.lit(0).cast("long").alias("score")))


SIBLING_SQL = """
WITH h AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM h) AND doc_id NOT IN (SELECT doc_id FROM h))
SELECT doc_id, 'hit' AS kind, n_chars AS score FROM h UNION ALL SELECT doc_id, 'sibling', 0 FROM o WHERE n <= 32
"""


def retrieval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark needle, in how many documents its text stands; case aside, white space run together, separators of thousands dropped."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"(?<=[0-9])[,\s](?=[0-9]{3}(?![A-Za-z0-9_]))", ""), r"\s+", " ")
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), plain(F.col("text")).alias("needle"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), plain(F.col("text")).alias("text"))
    found = holding(docs, needles).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("docs"), F.min("id").alias("first"))
    return needles.select(F.col("item").alias("item_id")).join(found, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), "first", F.col("docs").isNotNull().alias("hit"))


#: A separator between digits goes if three digits and no more follow; the engine can't look around, so what stands around is put back, and twice, as matches don't overlap.
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '([0-9])[,\s]([0-9]{3}\b)', '\1\2', 'g'), '([0-9])[,\s]([0-9]{3}\b)', '\1\2', 'g'), '\s+', ' ', 'g')"
HIT_SQL = f"""
WITH n AS (SELECT item_id, {_PLAIN} AS needle FROM benchmark), d AS (SELECT doc_id, {_PLAIN} AS hay FROM documents),
f AS (SELECT item_id, count(*) AS docs, min(doc_id) AS first FROM n JOIN d ON contains(hay, needle) GROUP BY 1)
SELECT item_id, coalesce(docs, 0) AS docs, first, docs IS NOT NULL AS hit FROM n LEFT JOIN f USING (item_id)
"""


def eval_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, length and toxic share by labelled quality and language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.groupBy("lang", "quality").agg(F.count("*").alias("n"), half_up(F.avg("n_chars"), 2).alias("chars"), half_up(F.avg("toxic"), 4).alias("toxic"))


EVAL_SQL = "SELECT lang, quality, count(*) AS n, floor(avg(n_chars) * 100 + 0.5) / 100 AS chars, floor(avg(toxic) * 10000 + 0.5) / 10000 AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"


def passage_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as one numbered passage, its length and checksum."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))  # a conversation's own turns
    passage = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("conv_id", F.size("l").alias("turns"), F.length(passage).alias("chars"), F.md5(passage.cast("binary")).alias("md5"))


PASSAGE_SQL = "SELECT conv_id, CAST(count(*) AS INT) AS turns, CAST(length(string_agg(l, chr(10) ORDER BY turn, l)) AS INT) AS chars, md5(string_agg(l, chr(10) ORDER BY turn, l)) AS md5 FROM (SELECT conv_id, turn, '[' || turn || '] ' || role || ': ' || coalesce(text, '') AS l FROM conversations) GROUP BY 1"

QUERIES = {f.__name__: f for f in (vector_topk_merge, sibling_expansion, retrieval_hit_rate, eval_by_quality, passage_assembly)}
SQL = {"vector_topk_merge": TOPK_SQL, "sibling_expansion": SIBLING_SQL, "retrieval_hit_rate": HIT_SQL, "eval_by_quality": EVAL_SQL, "passage_assembly": PASSAGE_SQL}
