"""PCA whitening of embeddings on an exact covariance.

Every entry c becomes the whole number x = floor(64 c) + 1000000. The fit list
is each distinct x vector once. Its scatter matrix is exact: every task
multiplies its rows modulo several primes, small enough for the products of a
block to be exact in double precision; the residues, a number for each pair of
dimensions, prime and task, are summed up, and Chinese remaindering gives the
whole numbers back. Rows are centred by the whole part of their mean before
they are multiplied, and its fraction is taken off exactly afterwards. What
the driver sees is the square of the vector length times the primes, however
many rows there are. The covariance's eigenvectors are taken in double precision.

Vectors that are null or hold null or non-finite entries are dropped; empty
ones have no components and so no rows. Vectors of each length are fitted on
their own. Repeated rows are each whitened; null ids stay. A component whose
variance is zero to double precision has whitened null and is left out of
``identity_error``; where all variance is zero, explained and identity_error
are null. Entries beyond 2^62 units count as that; a deviation that no long
can hold is null. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import rebatched, staged, struct_of
from siteloom.llm.vectors import usable

SCALE, SHIFT, FAR = 64.0, 1_000_000, 1 << 62
COMPONENTS = 16
PRIME_BITS = 20
BLOCK = 1 << 53 - 2 * PRIME_BITS  # rows whose products of residues add up exactly in a double


@dataclass(frozen=True)
class Fit:
    """What whitening needs for vectors of one length: everything in whole numbers but the axes."""

    n: int
    centre: list[int]  # the whole part of each mean
    rest: list[int]  # sums of what is left
    far: int  # the largest absolute entry after centring
    axes: np.ndarray  # dimensions x components, unit vectors
    values: np.ndarray  # eigenvalues, falling
    trace: float


def whole(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and x of the vectors that take part."""
    entry = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(FAR - SHIFT)), F.lit(-FAR)) + F.lit(SHIFT)
    return vectors.where(usable(vector)).select(F.col(id_column).alias("id"), F.transform(vector, entry).alias("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, int64 matrix) for each length in a batch."""
    lists = batch.column("x")
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[(ends[rows] - size)[:, None] + np.arange(size)].astype(np.int64)


def primes_for(bound: int) -> list[int]:
    """Primes below 2^PRIME_BITS, in falling order, whose product is over ``bound``."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def sums(fit: DataFrame) -> DataFrame:
    """dim, j, n, total, low and high of every place of the vectors of each length."""
    schema = struct_of(dim=T.IntegerType(), j=T.IntegerType(), n=T.LongType(), total=T.DecimalType(38, 0), low=T.LongType(), high=T.LongType())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in rebatched(batches, 8 << 20):
            for size, rows, x in by_length(batch):
                part = (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & (1 << 20) - 1).sum(axis=0).astype(object)
                n, total, low, high = held.get(size, (0, 0, x[0], x[0]))
                held[size] = n + len(rows), total + part, np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        for size, (n, total, low, high) in held.items():
            totals = pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), totals, pa.array(low), pa.array(high)], names=schema.names)

    return fit.mapInArrow(add, schema).groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def residue_scatter(fit: DataFrame, centres: dict[int, list[int]], primes: dict[int, list[int]]) -> DataFrame:
    """dim, prime, i, j and the sum of residues of x_i * x_j after centring, for i <= j."""
    schema = struct_of(dim=T.IntegerType(), prime=T.LongType(), i=T.IntegerType(), j=T.IntegerType(), residue=T.LongType())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in rebatched(batches, 8 << 20):
            for size, _, x in by_length(batch):
                y = x - np.asarray(centres[size], np.int64)
                for p in primes[size]:
                    residues = np.mod(y, p).astype(np.float64)
                    total = held.setdefault((size, p), np.zeros((size, size), np.int64))
                    for at in range(0, len(residues), BLOCK):
                        block = residues[at : at + BLOCK]
                        total += np.mod((block.T @ block).astype(np.int64), p)
                    total %= p
        for (size, p), total in held.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(np.full(len(i), p), pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=schema.names)

    return fit.mapInArrow(multiply, schema).groupBy("dim", "prime", "i", "j").agg(F.sum("residue").alias("residue"))


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The whole numbers, of either sign, with these residues by prime."""
    product = 1
    for p in residues:
        product *= p
    total = sum((np.mod(r, p).astype(object) * (product // p * pow(product // p, -1, p)) for p, r in residues.items()), start=0) % product
    return np.where(total > product // 2, total - product, total)


def learn(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """By vector length, the fit of all vectors ``x`` in ``fit``."""
    found: dict[int, list] = {}
    for row in sums(fit).orderBy("dim", "j").collect():  # a row for each place of a vector
        found.setdefault(row["dim"], []).append(row)
    centres, far, primes = {}, {}, {}
    for dim, rows in found.items():
        centres[dim] = [int(r["total"]) // r["n"] for r in rows]
        far[dim] = max(max(abs(r["low"] - c), abs(r["high"] - c)) for r, c in zip(rows, centres[dim], strict=True))
        primes[dim] = primes_for(2 * rows[0]["n"] * far[dim] ** 2 + 1)
    parts: dict[int, dict[int, np.ndarray]] = {}
    for row in residue_scatter(fit, centres, primes).collect() if found else []:  # the square of the length, times the primes
        own = parts.setdefault(row["dim"], {}).setdefault(row["prime"], np.zeros((row["dim"],) * 2, np.int64))
        own[row["i"], row["j"]] = row["residue"] % row["prime"]
    out = {}
    for dim, rows in found.items():
        n = rows[0]["n"]
        rest = [int(r["total"]) - n * c for r, c in zip(rows, centres[dim], strict=True)]
        scatter = remaindered(parts[dim])
        exact = [[n * int(scatter[min(i, j), max(i, j)]) - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
        cov = np.array([[v / (n * n) for v in line] for line in exact])
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        out[dim] = Fit(n, centres[dim], rest, far[dim], axes, values, sum(exact[i][i] for i in range(dim)) / (n * n))
    return out


def known(fit: Fit) -> np.ndarray:
    """Which components have a variance at all."""
    return fit.values > max(fit.values[0], 0.0) * len(fit.centre) * np.finfo(float).eps


def deviations(fit: Fit, x: np.ndarray) -> np.ndarray:
    """n x - S for every row and place, exact: whole numbers of the machine where they fit, else Python's."""
    small = fit.n * fit.far + max(map(abs, fit.rest)) < 1 << 62
    kind = np.int64 if small else object
    y = x.astype(object) - np.asarray(fit.centre, object) if not small else x - np.asarray(fit.centre, np.int64)
    return y.astype(kind) * fit.n - np.asarray(fit.rest, kind)


def projected(fit: Fit, away: np.ndarray) -> np.ndarray:
    """Whitened coordinates; nan where a component has no variance."""
    scale = np.where(known(fit), 1 / np.sqrt(np.where(known(fit), fit.values, 1.0)), np.nan)
    return (away.astype(np.float64) / fit.n) @ fit.axes * scale


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """By length, the largest absolute entry of the whitened fit list's covariance minus the identity."""
    schema = struct_of(dim=T.IntegerType(), i=T.IntegerType(), j=T.IntegerType(), total=T.DoubleType())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in rebatched(batches, 8 << 20):
            for size, rows, x in by_length(batch):
                white = projected(fits[size], deviations(fits[size], x))
                white = np.concatenate((white, np.ones((len(rows), 1))), axis=1)  # the last line holds the sums
                held[size] = held.get(size, 0) + white.T @ white
        for size, total in held.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=schema.names)

    out: dict[int, float | None] = {}
    totals: dict[int, np.ndarray] = {}
    for row in fit.mapInArrow(add, schema).groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect() if fits else []:
        k = len(fits[row["dim"]].values) + 1
        totals.setdefault(row["dim"], np.zeros((k, k)))[row["i"], row["j"]] = row["total"]
    for dim, total in totals.items():
        n, good = fits[dim].n, np.flatnonzero(known(fits[dim]))
        mean = total[-1, good] / n
        error = np.abs(total[np.ix_(good, good)] / n - np.outer(mean, mean) - np.eye(len(good)))
        out[dim] = float(error.max()) if len(good) else None
    return out


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    rows = whole(vectors, id_column, vector)
    fit = staged(rows.where(F.size("x") > 0).select("x").distinct())
    fits = learn(fit, components)
    errors = identity_errors(fit, fits)
    model = vectors.sparkSession.sparkContext.broadcast((fits, errors))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *struct_of(component=T.IntegerType(), n=T.LongType(), deviation=T.LongType(), whitened=T.DoubleType(), explained=T.DoubleType(), identity_error=T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 4 << 20):
            for size, own, x in by_length(batch):
                f, error = model.value[0][size], model.value[1][size]
                k = len(f.values)
                away = deviations(f, x)
                square = away if away.dtype != object and size * int(np.abs(away).max()) ** 2 < 1 << 63 else away.astype(object)
                total = [int(v) if v < 1 << 63 else None for v in (square * square).sum(axis=1)]
                white = projected(f, away).ravel()
                share = [float(v) / f.trace if f.trace > 0 else None for v in f.values]
                columns = [batch.column("id").take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()), pa.array(np.full(k * len(own), f.n), pa.int64()), pa.array(total, pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))), pa.array(white, from_pandas=True), pa.array(share * len(own), pa.float64()), pa.array([error] * (k * len(own)), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.where(F.size("x") > 0).mapInArrow(apply, schema).withColumnRenamed("id", id_column)
