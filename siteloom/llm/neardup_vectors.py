"""Near-duplicate vectors within a label: PCA-ordered tiles compared a few dimensions at a time.

Equal vectors of a label are one class with a count. Classes are rotated onto
the principal axes of all vectors, sorted along the first, and cut into tiles.
Two tiles meet only if their stretches of that axis come near enough for any
cosine to reach the threshold. Tiles are compared over leading dimensions
first; what the rest can still add is at most the product of the two suffix
norms (Cauchy-Schwarz), and a pair stops when that cannot reach the
threshold. The pairs left are decided by their cosine in double precision.

A tile pair returns a row for each linked class: how many vectors it met, and
one class of its cluster in the pair. So a large cluster yields rows as its
members and never as its pairs, and connections stay whole.

Vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing. Vectors of different length never link.
Repeated rows are equal vectors and link with each other. Null ids never name
a component unless all its ids are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import components, drop_staged, staged, struct_of
from siteloom.llm.vectors import doubles, matrix, unpacked, usable

THRESHOLD = 0.93
TILE = 1024
SLACK = 1e-9  # what rounding may add to a bound
LONG, DOUBLE, BINARY = T.LongType(), T.DoubleType(), T.BinaryType()


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the principal axes, largest first.

    Each task adds up its own second moments; what reaches the driver is one
    square matrix for each vector length.
    """
    schema = struct_of(dim=T.IntegerType(), place=T.IntegerType(), value=DOUBLE)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims).tolist():
                x = unit(matrix(batch.column("vec").filter(pa.array(dims == d))))
                held[d] = held.get(d, 0) + x.T @ x
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], names=schema.names)

    found = classes.select("dim", "vec").mapInArrow(moments, schema).groupBy("dim", "place").agg(F.sum("value").alias("value")).toArrow()
    out = {}
    for d in set(found.column("dim").to_pylist()):
        own = found.filter(pa.compute.equal(found.column("dim"), d)).sort_by("place")
        _, axes = np.linalg.eigh(own.column("value").to_numpy().reshape(d, d))
        out[d] = np.ascontiguousarray(axes[:, ::-1])
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose cosine reaches ``threshold``; of one tile with itself each pair once."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ axes, ub @ axes
    d = a.shape[1]
    rest_a, rest_b = (np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])) for r in (ra, rb))
    done = min(8, d)
    partial = ra[:, :done] @ rb[:, :done].T
    bound = partial + np.outer(rest_a[:, done], rest_b[:, done]) if done < d else partial
    i, j = np.nonzero(bound >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    sums = partial[i, j]
    while done < d and len(i):
        upto = min(d, done * 2)
        sums = sums + np.einsum("nd,nd->n", ra[i, done:upto], rb[j, done:upto])
        more = rest_a[i, upto] * rest_b[j, upto] if upto < d else 0.0
        keep = sums + more >= threshold - SLACK
        i, j, sums, done = i[keep], j[keep], sums[keep], upto
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    plain = np.isfinite(norm_a).all() and np.isfinite(norm_b).all() and norm_a.min(initial=1) > 1e-140 and norm_b.min(initial=1) > 1e-140
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        cosine = np.einsum("nd,nd->n", a[p], b[q]) / (norm_a[p] * norm_b[q]) if plain else np.einsum("nd,nd->n", ua[p], ub[q])
        keep[at : at + len(p)] = cosine >= threshold
    return i[keep], j[keep]


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its cluster under the links (u, v)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            return label


def tiles_of(classes: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """Tiles of classes next to each other on the first axis of their label and length."""
    held = classes.sparkSession.sparkContext.broadcast(axes)  # one square matrix for each vector length
    placed_schema = T.StructType([classes.schema[c] for c in ("cls", "label", "dim", "n", "vec")] + [T.StructField("first", DOUBLE)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            first = np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                first[dims == d] = unit(matrix(batch.column("vec").filter(pa.array(dims == d)))) @ held.value[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=placed_schema.names)

    tile_schema = T.StructType([classes.schema["label"], T.StructField("dim", T.IntegerType()), *(T.StructField(c, DOUBLE) for c in ("low", "high")), *(T.StructField(c, BINARY) for c in ("cls", "n", "vecs"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        key, rows = None, 0

        def flush() -> pa.RecordBatch:
            whole = pa.concat_batches(held_rows)
            first = np.asarray(whole.column("first"))
            pack = [np.asarray(whole.column(c)).astype(np.int64).tobytes() for c in ("cls", "n")] + [matrix(whole.column("vec")).tobytes()]
            return pa.RecordBatch.from_arrays([whole.column("label").slice(0, 1), pa.array([key[1]], pa.int32()), pa.array([first.min()]), pa.array([first.max()]), *(pa.array([x], pa.binary()) for x in pack)], names=tile_schema.names)

        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            at = 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and keys[end] == keys[at] and end - at < tile:
                    end += 1
                if held_rows and (keys[at] != key or rows >= tile):
                    yield flush()
                    held_rows, rows = [], 0
                end = min(end, at + tile - rows)
                key = keys[at]
                held_rows.append(batch.slice(at, end - at))
                rows += end - at
                at = end
        if held_rows:
            yield flush()

    placed = classes.select("cls", "label", "dim", "n", "vec").mapInArrow(place, placed_schema)
    ordered = placed.repartitionByRange("label", "dim", "first").sortWithinPartitions("label", "dim", "first", "cls")
    return staged(ordered.mapInArrow(cut, tile_schema).withColumn("tile", F.monotonically_increasing_id()))


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.when(F.col(label).isNotNull() & usable(vector), doubles(vector)).alias("vec"))
    rows = rows.withColumn("vec", F.when(F.exists("vec", lambda x: x != 0.0), F.col("vec")))
    rows = rows.withColumn("k1", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))).withColumn("k2", F.xxhash64(F.lit(77), "label", "vec"))
    classes = rows.where("vec IS NOT NULL").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec"))
    classes = staged(classes.withColumn("dim", F.size("vec")).withColumn("cls", F.monotonically_increasing_id()))
    axes = rotations(classes)
    tiles = tiles_of(classes, axes, tile)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    ends = lambda x: [F.col("tile").alias(f"tile_{x}"), "label", "dim", F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")]
    near = (F.col("tile_a") <= F.col("tile_b")) & (F.col("low_a") <= F.col("high_b") + reach) & (F.col("low_b") <= F.col("high_a") + reach)
    pairs = tiles.select(*ends("a")).join(tiles.select(*ends("b")), ["label", "dim"]).where(near).select("tile_a", "tile_b", "dim")
    packed = lambda x: tiles.select(F.col("tile").alias(f"tile_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "vecs")))
    meeting = pairs.join(packed("a"), "tile_a").join(packed("b"), "tile_b")
    held = vectors.sparkSession.sparkContext.broadcast(axes)
    schema = struct_of(cls=LONG, links=LONG, to=LONG)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k]  # noqa: B023, E731
                d = get("dim").as_py()
                a, b = (unpacked(get(c), np.float64).reshape(-1, d) for c in ("vecs_a", "vecs_b"))
                same = get("tile_a").as_py() == get("tile_b").as_py()
                i, j = linked_pairs(a, b, held.value[d], threshold, same)
                if not len(i):
                    continue
                cls = np.concatenate([unpacked(get(c), np.int64) for c in ("cls_a", "cls_b")[: 1 if same else 2]])
                n = np.concatenate([unpacked(get(c), np.int64) for c in ("n_a", "n_b")[: 1 if same else 2]])
                v = j if same else j + len(a)
                links = np.bincount(i, weights=n[v], minlength=len(cls)) + np.bincount(v, weights=n[i], minlength=len(cls))
                some = np.flatnonzero(links)
                to = cls[least_labels(len(cls), i, v)]
                yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(to[some])], names=schema.names)

    met = staged(meeting.mapInArrow(compare, schema))
    drop_staged(tiles)
    found = components(vectors.sparkSession, met, "cls", "to")
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "k1", "k2", "n", "least").join(found, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(links, "cls", "left")
    named = staged(named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked")))
    drop_staged(classes, met, found)
    out = rows.select("id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
