"""Exact top-k by inner product with no-random-access aggregation.

Components become whole numbers. For a query, every dimension is a list of the
candidates sorted by what that dimension adds to their score. The lists are
read in step, from the top, and only what has been read is added up. An entry
gives its candidate's score a lower bound (with the worst entry of the lists
it has not been seen in) and an upper bound (with the entries those lists have
come to). A candidate whose upper bound falls below the k-th best lower bound
is out for good; reading stops when too few are left to be worth a further
step, and these are then scored exactly.

Queries and candidates are packed into blocks. A task takes one block of
queries through the candidate blocks of a strip, one after another, the first
of them a small one, and keeps each query's k best scores so far as the floor
for the next block: a block whose best entries together stay below the floor
is not read at all.

Vectors that are null, empty, or hold null or non-finite components take no
part; vectors of other length than a query's are not its candidates. Equal
scores go to the smaller id. A row is never its own candidate; other rows with
its id are. Null ids are candidates, after all others, and never queries. All
sums are whole numbers below 2**53 and so exact; where they might not be the
search raises an ArithmeticError instead of returning a wrong score. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siteloom.llm.common import staged, struct_of
from siteloom.llm.vectors import matrix, unpacked, usable

K = 10
EVERY = 100
SCALE = 1024
CANDIDATES = 4096  # of a block at most
QUERIES = (64, 8192)  # of a block: so many that every core has work, within these bounds
BLOCK_BYTES = 4 << 20
STRIP = 8  # candidate blocks that one task goes through
FIRST = 512  # candidates of a strip that are searched first, for a floor
STEPS = 8  # in which a block's lists are read at most
LEAST_STEP = 64
EXACT = float(1 << 53)
LONG = T.LongType()


class Lists:
    """A block of candidates with every dimension's list, sorted either way; whole numbers, held as doubles."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.float64)
        rising = np.argsort(values, axis=0, kind="stable").T
        self.order = np.ascontiguousarray(np.concatenate((rising, rising[:, ::-1])))  # a row for each dimension and direction
        self.sorted = np.take_along_axis(np.concatenate((self.values.T, self.values.T)), self.order, axis=1)
        self.most = np.abs(self.values).max(axis=0) if len(values) else np.zeros(values.shape[1])


def read_lists(query: np.ndarray, lists: Lists, own: int, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, entries read): the candidates that may be among the query's k best, ties included.

    ``own`` is the place that doesn't count, or -1; ``floor`` the score that
    the query's k best so far reach.
    """
    n, d = lists.values.shape
    query = query.astype(np.float64)
    if np.abs(query) @ lists.most >= EXACT:
        raise ArithmeticError("scores may not be whole numbers below 2**53")
    lines = np.arange(d) + d * (query >= 0)
    best, worst = query * lists.sorted[lines, 0], query * lists.sorted[lines, -1]
    if floor is not None and best.sum() < floor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lower = np.full(n, worst.sum())  # of all; what is read adds its surplus over the worst
    unseen = np.ones((d, n))
    alive = np.delete(np.arange(n), own) if own >= 0 else np.arange(n)
    step, depth = max(LEAST_STEP, -(-n // STEPS)), 0
    base = (np.arange(d) * n)[:, None]
    while len(alive) > 2 * k and depth < n:
        upto = min(n, depth + step)
        who = lists.order[lines, depth:upto]
        adds = query[:, None] * lists.sorted[lines, depth:upto] - worst[:, None]
        np.add.at(lower, who.ravel(), adds.ravel())
        unseen.reshape(-1)[(who + base).ravel()] = 0
        depth = upto
        if len(alive) >= k:
            reached = float(np.partition(lower[alive], len(alive) - k)[len(alive) - k])
            floor = reached if floor is None else max(floor, reached)
        # Lists that a candidate has not been seen in can add no more than the entry they have come to.
        if floor is not None:
            alive = alive[(lower + adds[:, -1] @ unseen)[alive] >= floor]
        if len(alive) * 4 <= step:
            break
    return alive, (lists.values[alive] @ query).astype(np.int64), depth * d


class Best:
    """A query's k best candidates so far: higher scores first, then smaller ids, null ids last, then rows."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int | None:
        return -self.rows[-1][0] if len(self.rows) == self.k else None

    def add(self, scores: np.ndarray, named: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        new = zip((-scores).tolist(), (~named).tolist(), ids.tolist(), rows.tolist(), strict=True)
        self.rows = sorted([*self.rows, *new])[: self.k]


def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The rows dealt at random into blocks of at most about ``size`` rows and BLOCK_BYTES: block, dim, ids, rows, values; and how many."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("cells")).first()
    count = max(1, -(-found["n"] // size), -(-found["cells"] * 8 // BLOCK_BYTES))
    schema = struct_of(block=T.IntegerType(), dim=T.IntegerType(), ids=T.BinaryType(), named=T.BinaryType(), rows=T.BinaryType(), vecs=T.BinaryType())

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: table.column(c).combine_chunks()
        ids = get("id")
        return pa.table([pa.array([x], t) for x, t in ((table.column("block")[0].as_py(), pa.int32()), (table.column("dim")[0].as_py(), pa.int32()), (np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), pa.binary()), (np.asarray(ids.is_valid()).tobytes(), pa.binary()), (np.asarray(get("row")).astype(np.int64).tobytes(), pa.binary()), (matrix(get("vec"), np.int64).tobytes(), pa.binary()))], names=schema.names)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return staged(dealt.groupBy("block", "dim").applyInArrow(pack, schema)), count


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, query: Column | None = None, scale: int = SCALE) -> DataFrame:
    """query_id, rank, id and score: the k best candidates of each query (rows where ``query`` holds)."""
    query = query if query is not None else F.col(id_column) % EVERY == 0
    rows = vectors.where(usable(vector)).select(F.col(id_column).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vec"))
    rows = staged(rows.withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id()))
    found, n_found = blocks(rows.select("id", "dim", "row", "vec"), CANDIDATES)
    strips = -(-n_found // STRIP)
    asks = rows.where("asks").select("id", "dim", "row", "vec")
    share = -(-asks.count() * strips // (2 * vectors.sparkSession.sparkContext.defaultParallelism))
    # Each block of the stated queries goes once to each strip, and each block of candidates once to each block of queries.
    asked, n_asked = blocks(asks, min(max(share, QUERIES[0]), QUERIES[1]))
    asked = asked.withColumnRenamed("block", "q").withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    found = found.withColumn("strip", F.floor(F.col("block") / STRIP).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    schema = T.StructType([T.StructField(x, LONG) for x in ("query_row", "query_id", "vec_id", "row", "score")])

    def search(asks: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asks.num_rows and held.num_rows:
            get = lambda table, i, c, kind: unpacked(table.column(c)[i], kind)
            d = asks.column("dim")[0].as_py()
            queries, q_rows, q_ids = get(asks, 0, "vecs", np.int64).reshape(-1, d), get(asks, 0, "rows", np.int64), get(asks, 0, "ids", np.int64)
            best = [Best(k) for _ in q_rows]
            for i in range(held.num_rows):
                whole = get(held, i, "vecs", np.int64).reshape(-1, d), get(held, i, "rows", np.int64), get(held, i, "ids", np.int64), get(held, i, "named", bool)
                for part in (slice(0, FIRST), slice(FIRST, None)) if i == 0 else (slice(None),):
                    vecs, c_rows, c_ids, named = (x[part] for x in whole)
                    if not len(c_rows):
                        continue
                    lists, place = Lists(vecs), {r: at for at, r in enumerate(c_rows.tolist())}
                    for j, query in enumerate(queries):
                        at, scores, _ = read_lists(query, lists, place.get(int(q_rows[j]), -1), k, best[j].floor())
                        best[j].add(scores, named[at], c_ids[at], c_rows[at])
            out = [(int(q_rows[j]), int(q_ids[j]), None if unnamed else i, r, -s) for j, b in enumerate(best) for s, unnamed, i, r in b.rows]
        return pa.table({n: pa.array([x[c] for x in out], pa.int64()) for c, n in enumerate(schema.names)})

    best = asked.groupBy("q", "strip", "dim").cogroup(found.groupBy("q", "strip", "dim")).applyInArrow(search, schema)
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_column), "score")
