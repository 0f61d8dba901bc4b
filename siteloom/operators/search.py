"""Finding many needles in many texts in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 32  # characters of a needle that the automaton holds
MOST_NEEDLES, MOST_CHARS = 50_000, 64 << 20  # that every task may hold


def holding(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs of an item of ``needles`` (item, needle) and a text of ``texts`` (id, text) that holds the needle.

    As long as the needles fit the bounds above, each task looks for the
    beginnings of all of them at once and compares the rest where one is
    found; else every text meets every needle in a join. Nulls hold nothing
    and are held by nothing; an empty needle is in every text.
    """
    known = needles.where("needle IS NOT NULL").select("item", "needle")
    size = known.limit(MOST_NEEDLES + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("chars")).first()
    if size["n"] > MOST_NEEDLES or size["chars"] > MOST_CHARS:
        return texts.join(known, F.col("text").contains(F.col("needle"))).select("item", "id")
    held = texts.sparkSession.sparkContext.broadcast([(r["item"], r["needle"]) for r in known.collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_seed: dict[str, list[tuple[int, str]]] = {}
        for item, needle in held.value:
            by_seed.setdefault(needle[:SEED], []).append((item, needle))
        everywhere = [item for item, _ in by_seed.pop("", [])]
        found = ahocorasick.Automaton()
        for seed, own in by_seed.items():
            found.add_word(seed, (len(seed), own))
        found.make_automaton()
        for batch in batches:
            items, ids = [], []
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                hits = set(everywhere)
                for end, (length, own) in found.iter(text) if by_seed else ():
                    hits.update(item for item, needle in own if item not in hits and text.startswith(needle, end - length + 1))
                items += hits
                ids += [name] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.int64())], names=["item", "id"])

    return texts.select("id", "text").mapInArrow(search, "item long, id long")
