"""From raw documents to packed training sequences, a stage at a time.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import language, mixing, packing, simhash, substring


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with a margin, and note it in ``lang``."""
    return language.sure(docs, language.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of documents whose five-word shingles are alike to 0.8 or more, the one with the least id."""
    return simhash.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that stand more than once; documents left without words go."""
    return _measured(substring.cut(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as its source's target asks."""
    return mixing.emit(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: each piece with its tokens and the number of its copy, as documents may come twice."""
    return packing.pack(docs, with_ids=True, with_copy=True)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Compression, fingerprints and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next; what a stage has read or staged goes when it is written."""
    from siteloom.llm.common import drop_staged, staged_alone

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = staged_alone(lambda: stage(spark, before, sf_dir))  # noqa: B023
        drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
