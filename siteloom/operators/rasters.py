"""Rasters as tables of square tiles: masks closed, filled and claimed; exact distances; windows of stored blocks.

A tile is (ty, tx, data): ``side`` x ``side`` values in row order, packed. Tiles
that are missing hold nothing. A step that looks beyond its tile gets what it
needs from the neighbours by a shuffle on tiles; what reaches further goes
through states of tile borders or through connected components, so no step
has a window of fixed reach and no task sees the raster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.graph import connected
from siteloom.operators.staging import staged

TILE = "ty int, tx int, data binary"


def tiles_of(pixels: DataFrame, side: int, dtype: str, fill: float) -> DataFrame:
    """Tiles of (row, col, value) rows; pixels that are not there are ``fill``."""
    dealt = pixels.select(F.floor(F.col("row") / side).cast("int").alias("ty"), F.floor(F.col("col") / side).cast("int").alias("tx"), (F.pmod("row", F.lit(side)) * side + F.pmod("col", F.lit(side))).cast("int").alias("at"), F.col("value").cast("double").alias("value"))

    def pack(table: pa.Table) -> pa.Table:
        out = np.full(side * side, fill, dtype)
        value = table.column("value").to_numpy()
        known = ~np.isnan(value)
        out[table.column("at").to_numpy()[known]] = value[known].astype(dtype)
        return _tile(table, out)

    return dealt.groupBy("ty", "tx").applyInArrow(pack, TILE)


def _tile(table: pa.Table, data: np.ndarray) -> pa.Table:
    return pa.table({"ty": pa.array([table.column("ty")[0].as_py()], pa.int32()), "tx": pa.array([table.column("tx")[0].as_py()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})


def pixels_of(tiles: DataFrame, side: int, dtype: str, height: int, width: int, kind: str = "double") -> DataFrame:
    """(row, col, value) of every pixel of ``tiles`` within the raster."""

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                value = np.frombuffer(batch.column("data")[i].as_buffer(), dtype)
                row, col = np.divmod(np.arange(side * side), side)
                row, col = row + batch.column("ty")[i].as_py() * side, col + batch.column("tx")[i].as_py() * side
                own = (row < height) & (col < width)
                yield pa.RecordBatch.from_arrays([pa.array(row[own].astype(np.int64)), pa.array(col[own].astype(np.int64)), pa.array(value[own].astype(np.float64 if kind == "double" else np.int64))], names=["row", "col", "value"])

    return tiles.mapInArrow(unpack, f"row long, col long, value {kind}")


def all_tiles(tiles: DataFrame, side: int, height: int, width: int, empty: bytes) -> DataFrame:
    """``tiles`` with those that are missing from a raster of that size, holding ``empty``."""
    down, across = -(-height // side), -(-width // side)
    every = tiles.sparkSession.range(down * across).select(F.floor(F.col("id") / across).cast("int").alias("ty"), F.pmod("id", F.lit(across)).cast("int").alias("tx"))
    return every.join(tiles, ["ty", "tx"], "left").select("ty", "tx", F.coalesce("data", F.lit(empty)).alias("data"))


def near_pixels(tiles: DataFrame, reach: int, side: int, height: int, width: int, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A mask after ``step``, which takes a tile with ``reach`` pixels around it and gives the tile; beyond the raster and in missing tiles nothing is set.

    Only the strips that a neighbour needs are sent to it. Tiles without a set pixel are left out.
    """
    if reach > side:
        raise ValueError("a tile's neighbours must hold all that it can reach")
    down, across = -(-height // side), -(-width // side)

    def send(batches):
        cut = {-1: slice(0, reach), 0: slice(0, side), 1: slice(side - reach, side)}
        for batch in batches:
            for i in range(batch.num_rows):
                mask = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(side, side)
                ty, tx = batch.column("ty")[i].as_py(), batch.column("tx")[i].as_py()
                out = [(ty + dy, tx + dx, -dy, -dx, mask[cut[dy], cut[dx]].tobytes()) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= ty + dy < down and 0 <= tx + dx < across and (mask[cut[dy], cut[dx]].any() or dy == dx == 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(),) * 4 + (pa.binary(),), strict=True)], names=["ty", "tx", "dy", "dx", "data"])

    def meet(table: pa.Table) -> pa.Table:
        wide = np.zeros((side + 2 * reach, side + 2 * reach), np.uint8)
        place = {-1: slice(0, reach), 0: slice(reach, reach + side), 1: slice(reach + side, None)}
        for dy, dx, data in zip(*(table.column(c).to_pylist() for c in ("dy", "dx", "data")), strict=True):
            spot = wide[place[dy], place[dx]]
            spot[...] = np.frombuffer(data, np.uint8).reshape(spot.shape)
        out = step(wide.astype(bool))
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        out[max(0, height - ty * side) :] = False
        out[:, max(0, width - tx * side) :] = False
        return _tile(table, out.astype(np.uint8)) if out.any() else _tile(table, out).slice(0, 0)

    return tiles.mapInArrow(send, "ty int, tx int, dy int, dx int, data binary").groupBy("ty", "tx").applyInArrow(meet, TILE)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def closed(mask: DataFrame, radius: int, side: int, height: int, width: int) -> DataFrame:
    """A mask dilated by a disk and eroded again; what lies beyond the raster is never set."""

    def shifted(wide: np.ndarray):
        return [wide[radius + i : radius + i + side, radius + j : radius + j + side] for i, j in disk(radius)]

    dilated = near_pixels(mask, radius, side, height, width, lambda wide: np.logical_or.reduce(shifted(wide)))
    return near_pixels(dilated, radius, side, height, width, lambda wide: np.logical_and.reduce(shifted(wide)))


def background_labels(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """For each pixel that is not set, the number of the first pixel of its part of the tile, sides touching; -1 elsewhere.

    Rows fall into runs, and runs that overlap a run of the row above join its part.
    """
    side = len(mask)
    free = ~mask
    free[height:], free[:, width:] = False, False
    change = np.diff(np.pad(free, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, start), (_, end) = np.nonzero(change == 1), np.nonzero(change == -1)
    parent = list(range(len(row)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    begin = np.searchsorted(row, np.arange(side + 1))
    for r in range(1, side):
        a, b = begin[r - 1], begin[r]
        while a < begin[r] and b < begin[r + 1]:
            if start[a] < end[b] and start[b] < end[a]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    out = np.full((side, side), -1, np.int64)
    for k in range(len(row)):
        first = find(k)
        out[row[k], start[k] : end[k]] = row[first] * side + start[first]
    return out


def filled(mask: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """A mask with its holes: parts of the background, joined over tile borders, that don't reach the raster's border."""
    across = -(-width // side)
    whole = all_tiles(mask, side, height, width, bytes(side * side))

    def label(batch: pa.RecordBatch, i: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        ty, tx = batch.column("ty")[i].as_py(), batch.column("tx")[i].as_py()
        own = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(side, side).astype(bool)
        return ty, tx, own, background_labels(own, height - ty * side, width - tx * side)

    def parts(batches):
        """A row for each part, and one for each pixel of it at a border between tiles."""
        for batch in batches:
            for i in range(batch.num_rows):
                ty, tx, _, labels = label(batch, i)
                base = (ty * across + tx) * side * side
                rows, cols = np.arange(side) + ty * side, np.arange(side) + tx * side
                outer = labels[(rows == 0) | (rows == height - 1)].ravel(), labels[:, (cols == 0) | (cols == width - 1)].ravel()
                reach = np.unique(np.concatenate(outer))
                own = np.unique(labels[labels >= 0])
                out = [(base + own, np.full(len(own), -1), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.isin(own, reach))]
                for axis, line, edge in ((0, labels[0], (ty, tx)), (0, labels[-1], (ty + 1, tx)), (1, labels[:, 0], (ty, tx)), (1, labels[:, -1], (ty, tx + 1))):
                    at = np.flatnonzero(line >= 0)
                    out.append((base + line[at], np.full(len(at), axis), np.full(len(at), edge[0] * (across + 1) + edge[1]), at, np.zeros(len(at), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "axis", "edge", "at", "outside"])

    found = staged(whole.mapInArrow(parts, "node long, axis long, edge long, at long, outside boolean"))
    links = found.where("axis >= 0").groupBy("axis", "edge", "at").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b").distinct()
    nodes = found.where("axis < 0").select("node", "outside")
    roots = nodes.join(connected(nodes.select("node"), links), "node")
    holes = roots.join(roots.groupBy("root").agg(F.max("outside").alias("open")).where("NOT open").select("root"), "root")
    by_tile = holes.groupBy(F.floor(F.col("node") / (side * side)).alias("tile")).agg(F.collect_list(F.pmod("node", F.lit(side * side))).alias("holes"))  # at most a tile's pixels
    marked = whole.withColumn("tile", (F.col("ty") * across + F.col("tx")).cast("long")).join(by_tile, "tile", "left").select("ty", "tx", "data", "holes")

    def fill(batches):
        for batch in batches:
            data = []
            for i in range(batch.num_rows):
                _, _, own, labels = label(batch, i)
                holes = batch.column("holes")[i].as_py()
                data.append((own | np.isin(labels, holes) if holes else own).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("ty"), batch.column("tx"), pa.array(data, pa.binary())], names=["ty", "tx", "data"])

    return marked.mapInArrow(fill, TILE)


def claimed(masks: list[DataFrame], side: int) -> DataFrame:
    """Tiles of class numbers from 1: each pixel goes to the first of ``masks`` that has it; 0 for none."""
    own = None
    for number, mask in enumerate(masks, 1):
        part = mask.select("ty", "tx", F.lit(number).alias("number"), "data")
        own = part if own is None else own.unionByName(part)

    def claim(table: pa.Table) -> pa.Table:
        out = np.zeros(side * side, np.uint8)
        for number, data in sorted(zip(table.column("number").to_pylist(), table.column("data").to_pylist(), strict=True), reverse=True):
            out[np.frombuffer(data, np.uint8) > 0] = number
        return _tile(table, out)

    return own.groupBy("ty", "tx").applyInArrow(claim, TILE)


def envelope(cost: np.ndarray) -> np.ndarray:
    """For each row and column the least of ``cost`` at a row of its column plus the square of the way there: the lower envelope of parabolas, all columns at once."""
    rows, cols = cost.shape
    at = np.zeros((rows + 1, cols), np.int64)  # rows of the parabolas that stay, as stacks
    start = np.full((rows + 2, cols), -np.inf)  # from where each is the least
    top = np.full(cols, -1)
    every = np.arange(cols)
    for r in range(rows):
        open_ = np.isfinite(cost[r])
        while True:
            busy = every[open_ & (top >= 0)]
            if not len(busy):
                break
            last = at[top[busy], busy]
            meet = ((cost[r, busy] + r * r) - (cost[last, busy] + last * last)) / (2.0 * (r - last))
            over = meet <= start[top[busy], busy]
            top[busy[over]] -= 1
            start[top[busy[~over]] + 1, busy[~over]] = meet[~over]
            open_ = np.zeros(cols, bool)
            open_[busy[over]] = True
            if not over.any():
                break
        own = every[np.isfinite(cost[r])]
        top[own] += 1
        at[top[own], own] = r
        start[top[own], own] = np.where(top[own] == 0, -np.inf, start[top[own], own])
        start[top[own] + 1, own] = np.inf
    out = np.full((rows, cols), np.inf)
    place = np.zeros(cols, np.int64)
    some = every[top >= 0]
    for r in range(rows):
        while True:
            late = some[start[place[some] + 1, some] < r]
            if not len(late):
                break
            place[late] += 1
        row = at[place[some], some]
        out[r, some] = cost[row, some] + (r - row) ** 2
    return out


def squared_distances(mask: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """Tiles of float64: for each pixel the squared distance to the nearest pixel of the raster that is not set; infinite if there is none.

    Along rows each tile hands its outermost free pixels on to all tiles of its
    row, as one window over a row's tiles; along columns a task takes a strip of
    ``side`` columns, so its memory grows with the raster's height and not its area.
    """
    whole = all_tiles(mask, side, height, width, bytes(side * side))

    def free_of(batch: pa.RecordBatch, i: int) -> tuple[int, int, np.ndarray]:
        ty, tx = batch.column("ty")[i].as_py(), batch.column("tx")[i].as_py()
        free = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(side, side) == 0
        free[max(0, height - ty * side) :] = False
        free[:, max(0, width - tx * side) :] = False
        return ty, tx, free

    def ends(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ty, tx, free = free_of(batch, i)
                has = free.any(axis=1)
                first, last = free.argmax(axis=1) + tx * side, side - 1 - free[:, ::-1].argmax(axis=1) + tx * side
                yield pa.RecordBatch.from_arrays([pa.array(np.full(side, ty), pa.int32()), pa.array(np.full(side, tx), pa.int32()), pa.array(np.arange(side), pa.int32()), pa.array(first, pa.int64(), mask=~has), pa.array(last, pa.int64(), mask=~has)], names=["ty", "tx", "r", "first", "last"])

    line = "PARTITION BY ty, r ORDER BY tx ROWS BETWEEN"
    state = whole.mapInArrow(ends, "ty int, tx int, r int, first long, last long").select("ty", "tx", "r", F.expr(f"max(last) OVER ({line} UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("left"), F.expr(f"min(first) OVER ({line} 1 FOLLOWING AND UNBOUNDED FOLLOWING)").alias("right"))
    packed = state.groupBy("ty", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "left", "right"))), lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"))).alias("state"))

    def along(table: pa.Table) -> pa.Table:
        """A strip of columns: rows' distances to the nearest free pixel, then the envelope down the columns."""
        table = table.sort_by("ty")
        cost = np.full((len(table) * side, side), np.inf)
        for i, batch in enumerate(table.to_batches(1)):
            _, tx, free = free_of(batch, 0)
            col = np.arange(side) + tx * side
            states = batch.column("state")[0].values
            left, right = (np.asarray(states.field(k).to_numpy(zero_copy_only=False), float) for k in (0, 1))
            before = np.maximum.accumulate(np.where(free, col, -np.inf), axis=1)
            after = np.minimum.accumulate(np.where(free, col, np.inf)[:, ::-1], axis=1)[:, ::-1]
            before = np.maximum(before, np.where(np.isnan(left), -np.inf, left)[:, None])
            after = np.minimum(after, np.where(np.isnan(right), np.inf, right)[:, None])
            cost[i * side : (i + 1) * side] = np.minimum(col - before, after - col) ** 2
        cost[height:] = np.inf
        out = envelope(cost)
        n = len(table)
        return pa.table({"ty": table.column("ty"), "tx": table.column("tx"), "data": pa.array([out[i * side : (i + 1) * side].tobytes() for i in range(n)], pa.binary())})

    return whole.join(packed, ["ty", "tx"]).groupBy("tx").applyInArrow(along, TILE)
