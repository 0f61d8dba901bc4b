"""Exact search over vectors, a block of queries against a block of vectors at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES, VECTORS = 2048, 8192  # rows of a block
SOME = 128  # queries of a block that are scored at once
DIGITS = 1e9  # scores are compared at nine decimals


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its id repeated, and the ids and scores of the ``k`` best vectors, which stand by id; some queries' scores are held at once."""
    for at in range(0, len(q), SOME):
        scores = q[at : at + SOME] @ v.T
        scores *= DIGITS
        scores += 0.5
        np.floor(scores, out=scores)
        scores /= DIGITS
        scores[q_ids[at : at + SOME, None] == ids[None, :]] = -np.inf
        for name, row in zip(q_ids[at : at + SOME], scores, strict=True):
            some = np.argsort(-row, kind="stable")[:k]
            some = some[np.isfinite(row[some])]
            yield np.full(len(some), name), ids[some], row[some]


def best_by_cosine(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, id and score: the ``k`` best of ``vectors`` (id, vec) for each row of ``asked`` within its pair of blocks, itself left out.

    The best of all are among them: as many rows a query as there are blocks,
    times ``k``. Of equal scores the smaller ids stay. Vectors without length
    or of another length than the query take no part.
    """
    schema = "query long, id long, score double"
    n_asked, n_vectors = (max(1, -(-d.count() // size)) for d, size in ((asked, QUERIES), (vectors, VECTORS)))
    deal = lambda d, own, n, other, m: d.select("id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(asked, "q", n_asked, "v", n_vectors), deal(vectors, "v", n_vectors, "q", n_asked)

    def search(asks: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asks.num_rows and held.num_rows:
            (q_ids, q), (ids, v) = (unit(t) for t in (asks, held))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            out = list(best_of(q_ids, q, ids, v, k))
        parts = [np.concatenate(x) if out else np.zeros(0) for x in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query", "id", "score"), parts, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    def unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy().astype(np.int64)
        rows = np.asarray(table.column("vec").combine_chunks().flatten()).astype(np.float64).reshape(len(ids), -1)
        length = np.sqrt((rows * rows).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        return ids[good], rows[good] / length[good, None]

    return left.groupBy("q", "v", "dim").cogroup(right.groupBy("q", "v", "dim")).applyInArrow(search, schema)
