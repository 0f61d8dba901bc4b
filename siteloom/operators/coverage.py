"""Exact area of what many rings cover together.

Rings may overlap, cross themselves, be concave or have holes: a polygon is all
rings of one id, and a point is in it if it lies in an odd number of them.
Rings are cut to grid cells, so that a group of any size is spread over tasks;
cells that hold many pieces are cut again. In each cell a sweep cuts the plane
into strips between the ends and crossings of edges; within a strip edges don't
cross, so their order tells where the polygons are, and the covered bands
between edges are added up. Cells add up to the group.

Edges are straight in longitude and latitude, and the area below one on the
sphere is its integral, so cutting an edge changes no sum. Empty rings and
rings under three corners cover nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions.geo import EARTH_KM
from siteloom.operators.staging import staged

#: What a ring is to its group: it covers, only what lies in it counts, or what lies in it does not count.
ZONE, WINDOW, HOLE = "zone", "window", "hole"
CROWD = 64  # pieces of a cell above which it is cut again
PIECES = 1 << 19  # of edges that a sweep holds at once, about
SHORT = 256  # corners of a ring that is cut without arrays
FINEST = 6  # a cell's sides are halved as often as that at most
FEW = 8  # pieces of a cell above which the sweep of a window cuts it again on its own
BOXES = 1 << 17  # cells that the boxes of rings cut at once hold, about


def half(points: np.ndarray, axis: int, bound: float, above: bool) -> np.ndarray:
    """The part of an open ring on one side of a line along an axis."""
    off = (points[:, axis] - bound) * (1 if above else -1)
    inside = off >= 0
    if inside.all() or not inside.any():
        return points if len(points) and inside.all() else points[:0]
    after = np.roll(points, -1, axis=0)
    crosses = inside != np.roll(inside, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        met = points + (after - points) * (off / (off - np.roll(off, -1)))[:, None]
    met[:, axis] = bound
    both = np.stack((points, met), axis=1).reshape(-1, 2)
    return both[np.stack((inside, crosses), axis=1).ravel()]


def _half(points: list[tuple[float, float]], axis: int, bound: float, above: bool) -> list[tuple[float, float]]:
    """The same for a short ring, which plain tuples pass faster than arrays."""
    off = [p[axis] - bound if above else bound - p[axis] for p in points]
    if not points or min(off) >= 0:
        return points
    if max(off) < 0:
        return []
    out, p, o = [], points[-1], off[-1]
    cut: tuple[float, float] | None = None
    for q, t in zip(points, off, strict=True):
        if (o >= 0) != (t >= 0):
            at = o / (o - t)
            cut = (bound, p[1] + (q[1] - p[1]) * at) if axis == 0 else (p[0] + (q[0] - p[0]) * at, bound)
            out.append(cut)
        if t >= 0:
            out.append(q)
        p, o = q, t
    return out


def pieces_of(ring: np.ndarray, size: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(cx, cy, piece) of an open ring for each cell of ``size`` degrees that it covers a part of."""
    if len(ring) <= SHORT:
        for cx, cy, piece in _pieces(list(map(tuple, ring.tolist())), size, _half):
            yield cx, cy, np.array(piece)
    else:
        yield from _pieces(ring, size, half)


def _pieces(ring, size: float, half: Callable) -> Iterator[tuple[int, int, np.ndarray | list]]:
    ends = lambda points, axis: range(math.floor(min(p[axis] for p in points) / size), math.floor(max(p[axis] for p in points) / size) + 1)
    for cx in ends(ring, 0):
        strip = half(half(ring, 0, cx * size, True), 0, (cx + 1) * size, False)
        if len(strip) < 3:
            continue
        for cy in ends(strip, 1):
            piece = half(half(strip, 1, cy * size, True), 1, (cy + 1) * size, False)
            if len(piece) > 2:
                yield cx, cy, piece


def _cut(rings: DataFrame, cell: float) -> DataFrame:
    """``rings`` (xs, ys, halvings and more), cut to their ``box`` if they have one and to the cells of ``cell`` degrees, halved so often, that they touch, as cx, cy."""
    boxed = "box" in rings.columns
    others = [c for c in rings.columns if c not in ("xs", "ys", "cx", "cy", "box")]
    schema = T.StructType([*(rings.schema[c] for c in others), *(T.StructField(c, T.LongType()) for c in ("cx", "cy")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xs", "ys"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                of, cxs, cys, xs, ys = [], [], [], [], []
                sizes = cell / 2.0 ** batch.column("halvings").to_numpy()
                for i, (x, y) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
                    ring = np.stack([x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)], axis=1)
                    if boxed:
                        box = batch.column("box")[i].values.to_numpy()
                        for axis in (0, 1):
                            ring = half(half(ring, axis, box[axis], True), axis, box[axis + 2], False)
                        if len(ring) < 3:
                            continue
                    for cx, cy, piece in pieces_of(ring, sizes[i]):
                        of.append(i)
                        cxs.append(cx)
                        cys.append(cy)
                        xs.append(piece[:, 0])
                        ys.append(piece[:, 1])
                kept = batch.select(others).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cxs, pa.int64()), pa.array(cys, pa.int64()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.float64()))], names=schema.names)

    return rings.select(*others, "xs", "ys", *(["box"] if boxed else [])).mapInArrow(cut, schema)


def covered_km2(parts: DataFrame, keys: list[str], cell: float, within: bool = False) -> DataFrame:
    """The ``keys`` and ``km2``: the area in at least one zone of the group, outside all its holes and, if ``within``, in one of its windows.

    ``parts`` holds the keys, ``polygon`` (an id), ``role`` and ``ring``, an open
    array of (x, y). Groups that cover nothing are left out. Polygons of equal rings
    are taken once; those of several rings must have an id that no other polygon
    of their group and role has.
    """
    usable = (F.size("ring") > 2) & F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    flat = parts.where(usable).select(*keys, "role", "polygon", F.transform("ring", lambda p: p["x"].cast("double")).alias("xs"), F.transform("ring", lambda p: p["y"].cast("double")).alias("ys"))
    one = flat.groupBy(*keys, "role", "polygon").agg(F.sort_array(F.collect_list(F.struct("xs", "ys"))).alias("rings"))
    one = one.dropDuplicates([*keys, "role", "rings"]).withColumn("ring", F.explode("rings")).select(*keys, "role", "polygon", F.col("ring.xs").alias("xs"), F.col("ring.ys").alias("ys"), F.lit(0).alias("halvings"))
    if within:  # nothing beyond the windows' box counts
        ends = [F.min(F.array_min("xs")), F.min(F.array_min("ys")), F.max(F.array_max("xs")), F.max(F.array_max("ys"))]
        one = one.join(one.where(F.col("role") == WINDOW).groupBy(*keys).agg(F.array(*ends).alias("box")), keys)
    coarse = _cut(one, cell)
    place = [*keys, "cx", "cy"]
    counts = coarse.groupBy(*place).agg(F.count("*").alias("pieces"), F.count_if(F.col("role") == ZONE).alias("zones"), F.count_if(F.col("role") == WINDOW).alias("windows"))
    wanted = counts.where("zones > 0 AND windows > 0" if within else "zones > 0")
    halvings = F.least(F.lit(FINEST), F.greatest(F.lit(0), F.ceil(F.log2(F.col("pieces") / CROWD) / 2))).cast("int")
    held = coarse.drop("halvings").join(wanted.select(*place, halvings.alias("halvings")), place)
    pieces = _cut(held, cell).withColumn("polygon", F.xxhash64("role", "polygon"))
    kinds = {f.name: f.dataType for f in pieces.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keys), "area double"])

    def sweep(table: pa.Table) -> pa.Table:
        xs, ys = (table.column(c).combine_chunks() for c in ("xs", "ys"))
        sizes = np.diff(np.asarray(xs.offsets))
        x, y = np.asarray(xs.flatten()), np.asarray(ys.flatten())
        of = np.repeat(np.arange(len(sizes)), sizes)
        after = np.arange(len(x)) + 1
        ends = np.cumsum(sizes)
        after[ends - 1] = ends - sizes
        polygon = np.unique(table.column("polygon").to_numpy(), return_inverse=True)[1][of]
        role = np.asarray([(ZONE, WINDOW, HOLE).index(r) for r in table.column("role").to_pylist()])[of]
        area = swept(np.stack([x, y, x[after], y[after]], axis=1), polygon, role, within)
        return pa.table({**{k: table.column(k)[:1] for k in keys}, "area": pa.array([area])})

    swept_cells = pieces.groupBy(*keys, "cx", "cy", "halvings").applyInArrow(sweep, schema)
    return swept_cells.groupBy(*keys).agg(F.sum("area").alias("km2")).where("km2 > 0")


def fills(piece: list[tuple[float, float]], cx: int, cy: int, size: float) -> bool | None:
    """Whether a piece is its whole cell; None if it has no area."""
    x0, y0, x1, y1 = cx * size, cy * size, (cx + 1) * size, (cy + 1) * size
    middle, odd, (x, y) = (cy + 0.5) * size, False, piece[-1]
    for u, v in piece:
        if not ((x == u and (x == x0 or x == x1)) or (y == v and (y == y0 or y == y1))):
            return False
        if x == x1 and (y > middle) != (v > middle):
            odd = not odd
        x, y = u, v
    return True if odd else None


def _sides(x: np.ndarray, y: np.ndarray, ring: np.ndarray, axis: int, bound: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``half`` for many open rings at once, each with a bound of its own: corners (x, y) of the ring they belong to, in order."""
    after, at = following(ring), bound[ring]
    off = (x if axis == 0 else y) - at
    off = off if above else -off
    inside = off >= 0
    kept = np.stack((inside, inside != inside[after]), axis=1).ravel()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = off / (off - off[after])
        met = [at if axis == i else own + (own[after] - own) * part for i, own in enumerate((x, y))]
    return *(np.stack((own, cut), axis=1).ravel()[kept] for own, cut in zip((x, y), met, strict=True)), np.repeat(ring, 2)[kept]


def following(ring: np.ndarray) -> np.ndarray:
    """The place of the next corner of each corner's ring; rings are numbered in order."""
    after = np.arange(len(ring)) + 1
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ring)), bool), ring[1:] != ring[:-1])))
    after[np.concatenate((first[1:], [len(ring)]))[: len(first)] - 1] = first
    return after


def _cells(x: np.ndarray, y: np.ndarray, ring: np.ndarray, n: int, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Open rings cut to cells: of each piece its ring, cx and cy, and of the pieces' corners x, y and the number of the piece."""
    owner, places = np.arange(n), []
    for axis in (0, 1):
        own = x if axis == 0 else y
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, ring, own)
        np.maximum.at(high, ring, own)
        held = np.bincount(ring, minlength=n) > 2
        first = np.floor(np.where(held, low, 0) / size).astype(np.int64)
        times = np.where(held, np.floor(np.where(held, high, 0) / size).astype(np.int64) - first + 1, 0)
        # Each ring is repeated for every strip that it reaches into.
        of = np.repeat(np.arange(n), times)
        strip = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + first[of]
        sizes = np.bincount(ring, minlength=n)
        start, length = (np.cumsum(sizes) - sizes)[of], sizes[of]
        new = np.repeat(np.arange(len(of)), length)
        corner = np.arange(len(new)) - np.repeat(np.cumsum(length) - length, length) + start[new]
        x, y, ring, n = x[corner], y[corner], new, len(of)
        owner, places = owner[of], [*(p[of] for p in places), strip]
        x, y, ring = _sides(x, y, ring, axis, strip * size, True)
        x, y, ring = _sides(x, y, ring, axis, (strip + 1) * size, False)
    kept = np.bincount(ring, minlength=n) > 2
    number = np.cumsum(kept) - 1
    return owner[kept], places[0][kept], places[1][kept], x[kept[ring]], y[kept[ring]], number[ring[kept[ring]]]


def _filled(x: np.ndarray, y: np.ndarray, piece: np.ndarray, cx: np.ndarray, cy: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """``fills`` for many pieces: which are their whole cell, and which have an area."""
    after = following(piece)
    u, v, x0, x1, y0, y1 = x[after], y[after], *((c * size)[piece] for c in (cx, cx + 1, cy, cy + 1))
    inner = ~(((x == u) & ((x == x0) | (x == x1))) | ((y == v) & ((y == y0) | (y == y1))))
    middle = ((cy + 0.5) * size)[piece]
    within = np.bincount(piece[inner], minlength=len(cx)) > 0
    odd = np.bincount(piece[(x == x1) & ((y > middle) != (v > middle))], minlength=len(cx)) % 2 == 1
    return ~within & odd, within | odd


def _lists(x: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)), pa.array(x))


def _chunks(batch: pa.RecordBatch, size: float) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """``batch`` (xs, ys and more) some rings at a time, with what ``_cells`` makes of them."""
    xs, ys = batch.column("xs"), batch.column("ys")
    sizes = pc.list_value_length(xs).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    reach = [np.maximum.reduceat(c, starts) // size - np.minimum.reduceat(c, starts) // size + 1 for c in (x, y)] if len(x) else [np.zeros(0)] * 2
    pieces = np.cumsum(reach[0] * reach[1])
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(pieces, (pieces[start - 1] if start else 0) + BOXES)))
        own = slice(starts[start], ends[stop - 1])
        yield batch.slice(start, stop - start), _cells(x[own], y[own], np.repeat(np.arange(stop - start), sizes[start:stop]), stop - start, size)
        start = stop


def _dealt_zones(rings: DataFrame, groups: str, size: float) -> DataFrame:
    """``rings`` (groups, xs, ys) cut to the cells of ``size`` degrees: group, cx, cy, ``whole`` and the piece.

    Pieces that are all of their cell come without points, and of the rings that
    are cut at a time no other piece of their group and cell comes with them.
    """
    schema = T.StructType([T.StructField("group", rings.schema[groups].dataType.elementType), *(T.StructField(c, T.LongType()) for c in ("cx", "cy")), T.StructField("whole", T.BooleanType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xs", "ys"))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch, (owner, cx, cy, x, y, piece) in _chunks(full, size):
                whole, some = _filled(x, y, piece, cx, cy, size)
                own = batch.column(groups)
                names, codes = own.flatten(), {}
                code = np.array([codes.setdefault(tuple(g.values()), len(codes)) for g in names.to_pylist()], np.int64)
                times = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                # A row for each piece and group of its ring.
                count = np.where(some, times[owner], 0)
                of = np.repeat(np.arange(len(owner)), count)
                at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + (np.cumsum(times) - times)[owner[of]]
                cell = np.unique(np.stack((cx, cy), axis=1), axis=0, return_inverse=True)[1].reshape(-1)
                place = code[at] * (len(cx) + 1) + cell[of]
                full_places, first = np.unique(np.where(whole[of], place, -1), return_index=True)
                kept = np.concatenate((first[full_places >= 0], np.flatnonzero(~whole[of] & ~np.isin(place, full_places))))
                of, at = of[kept], at[kept]
                corners = [_lists(c, piece, len(cx)).take(pa.array(np.where(whole[of], -1, of), pa.int64(), mask=whole[of])) for c in (x, y)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(cx[of]), pa.array(cy[of]), pa.array(whole[of]), *corners], names=schema.names)

    return rings.select(groups, "xs", "ys").mapInArrow(deal, schema)


def _dealt_windows(rings: DataFrame, key: str, size: float) -> DataFrame:
    """``rings`` (key, xs, ys) cut to the cells of ``size`` degrees, as cx, cy, with the ``area`` of the piece."""
    schema = T.StructType([rings.schema[key], *(T.StructField(c, T.LongType()) for c in ("cx", "cy")), T.StructField("area", T.DoubleType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xs", "ys"))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for batch, (owner, cx, cy, x, y, piece) in _chunks(full, size):
                after = following(piece)
                area = np.abs(np.bincount(piece, below(x, y, x[after], y[after]), len(cx)))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(cx), pa.array(cy), pa.array(area), *(_lists(c, piece, len(cx)) for c in (x, y))], names=schema.names)

    return rings.select(key, "xs", "ys").mapInArrow(deal, schema)


def covered_in_windows(zones: DataFrame, windows: DataFrame, key: str, groups: str, size: float, tasks: int) -> DataFrame:
    """``key``, the fields of ``groups`` and ``km2``: what of each window (key, ring) the zones (groups, ring) of each group cover together.

    ``groups`` is an array of the groups, as structs, that a zone belongs to. A ring is a
    polygon of its own. Zones are cut to cells and met there once for all windows: in a cell
    that one of them fills the others don't matter, and only what is left of a window
    there counts. So the denser zones lie, the fewer are swept. Crowded cells are cut again.
    """
    flat = lambda d, *more: d.where((F.size("ring") > 2) & F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())).select(*more, F.transform("ring", lambda p: p["x"].cast("double")).alias("xs"), F.transform("ring", lambda p: p["y"].cast("double")).alias("ys"))
    near = [F.floor(F.get(c, F.lit(0)) / (10 * size)) for c in ("xs", "ys")]
    # Zones that lie together are cut together, so that those that fill a cell keep the others' pieces of it from the shuffle.
    left = flat(zones, groups).repartitionByRange(tasks, *near, F.get("xs", F.lit(0))).sortWithinPartitions(*near)
    shapes = flat(windows, key).repartition(tasks)
    names = zones.schema[groups].dataType.elementType
    schema = ", ".join([f"`{key}` {windows.schema[key].dataType.simpleString()}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in names), "area double"])
    found, level = None, 0
    while True:
        side = size / 2**level
        own = F.collect_set(F.when(~F.col("whole"), F.struct("xs", "ys")))
        cells = staged(_dealt_zones(left, groups, side).groupBy("group", "cx", "cy").agg(F.bool_or("whole").alias("whole"), own.alias("pieces")).withColumn("pieces", F.when(F.col("whole"), F.slice("pieces", 1, 0)).otherwise(F.col("pieces"))))
        seen = staged(_dealt_windows(shapes, key, side))
        crowded = cells.where(F.size("pieces") > CROWD)
        last = level == FINEST or crowded.isEmpty()
        full = cells.where("whole").groupBy("cx", "cy").agg(F.collect_list("group").alias("held"))
        now = seen.where("area > 0").select(key, "cx", "cy", "area").join(full.hint("merge"), ["cx", "cy"]).select(key, F.explode("held").alias("group"), "area").select(key, "group.*", "area")
        swept_cells = cells.where(~F.col("whole") if last else ~F.col("whole") & (F.size("pieces") <= CROWD))
        met = seen.where("area > 0").join(swept_cells.hint("merge"), ["cx", "cy"])
        now = now.unionByName(met.repartition(tasks).select(key, "group", "cx", "cy", "xs", "ys", "pieces").mapInArrow(_areas(key, names.names, side), schema))
        found = now if found is None else found.unionByName(now)
        if last:
            return found.groupBy(key, *names.names).agg(F.sum("area").alias("km2")).where("km2 > 0")
        left = crowded.select(F.array("group").alias(groups), F.explode("pieces").alias("p")).select(groups, "p.xs", "p.ys").repartition(tasks)
        shapes = seen.join(crowded.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select(key, "xs", "ys").repartition(tasks)
        level += 1


def _areas(key: str, names: list[str], side: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the zones' pieces of each row cover of its window's piece."""

    def lengths(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for at in range(0, full.num_rows, 256):
                batch = full.slice(at, 256)
                n = batch.num_rows
                parts = batch.column("pieces").flatten()
                zone_xs, zone_ys = pc.struct_field(parts, "xs"), pc.struct_field(parts, "ys")
                sizes = np.concatenate((lengths(batch.column("xs")), lengths(zone_xs)))
                row = np.concatenate((np.arange(n), np.repeat(np.arange(n), lengths(batch.column("pieces")))))
                x, y = (np.concatenate((batch.column(c).flatten().to_numpy(zero_copy_only=False), z.flatten().to_numpy(zero_copy_only=False))) for c, z in (("xs", zone_xs), ("ys", zone_ys)))
                area = covered_each(x, y, np.repeat(np.arange(len(sizes)), sizes), row, np.arange(len(sizes)) < n, batch.column("cx").to_numpy(), side)
                group = batch.column("group")
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pc.struct_field(group, c) for c in names), pa.array(area)], names=[key, *names, "area"])

    return areas


def covered_each(x: np.ndarray, y: np.ndarray, ring: np.ndarray, row: np.ndarray, window: np.ndarray, cx: np.ndarray, side: float) -> np.ndarray:
    """What of each row's windows its zones cover, in cells of ``side`` degrees in columns ``cx``; ``ring`` numbers the corners' rings, ``row`` and ``window`` tell what those are.

    Rows of few pieces are swept, side by side along x. The others are cut in four, as often as
    ``FINEST``, where parts that a zone fills or that no window meets need no sweep.
    """
    total = np.zeros(len(cx))
    parent = np.arange(len(cx))
    for depth in range(FINEST + 1):
        count = np.bincount(row[~window], minlength=len(cx))
        small = count <= (FEW if depth < FINEST else np.inf)
        own = small[row]
        if own.any():
            stride, place = side * 1.25, np.cumsum(small) - 1
            held = own[ring]
            number = (np.cumsum(own) - 1)[ring[held]]
            at = row[ring[held]]
            after = following(number)
            xs = x[held] - cx[at] * side + place[at] * stride + side / 8
            ys = y[held]
            np.add.at(total, parent[small], swept_each(np.stack([xs, ys, xs[after], ys[after]], axis=1), number, window[ring[held]].astype(int), True, stride, int(small.sum())))
        if own.all():
            break
        held = ~own[ring]
        side /= 2
        owner, px, py, x, y, piece = _cells(x[held], y[held], (np.cumsum(~own) - 1)[ring[held]], int((~own).sum()), side)
        row, window = row[~own][owner], window[~own][owner]
        after = following(piece)
        size = np.abs(np.bincount(piece, below(x, y, x[after], y[after]), len(owner)))
        whole, some = _filled(x, y, piece, px, py, side)
        cells, of = np.unique(np.stack((row, px, py), axis=1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        full = np.bincount(of[whole & ~window], minlength=len(cells)) > 0
        np.add.at(total, parent[row[window & full[of]]], size[window & full[of]])
        left = (np.bincount(of[window & (size > 0)], minlength=len(cells)) > 0) & (np.bincount(of[some & ~window], minlength=len(cells)) > 0) & ~full
        kept = left[of] & np.where(window, size > 0, some)
        corners = kept[piece]
        x, y, ring = x[corners], y[corners], (np.cumsum(kept) - 1)[piece[corners]]
        row, window = (np.cumsum(left) - 1)[of[kept]], window[kept]
        parent, cx = parent[cells[left, 0]], cells[left, 1]
        if not len(row):
            break
    return total


def below(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The integral of sin(latitude) over longitude along straight pieces, in km2 of the sphere."""
    a, b = np.radians(y0), np.radians(y1)
    half = (b - a) / 2
    # (cos a - cos b) / (b - a) without the loss of digits for small differences
    mean = np.sin((a + b) / 2) * np.sinc(half / np.pi)
    return np.radians(x1 - x0) * mean * EARTH_KM**2


def crossings(edges: np.ndarray, block: int = 128) -> np.ndarray:
    """Places along x where two edges (left end first) cross."""
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    ax, ay, bx, by = edges.T
    slope = (by - ay) / (bx - ax)
    out = []
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    for at in range(0, len(edges), block):
        i = np.arange(at, min(at + block, len(edges)))
        j = np.arange(at, int(np.searchsorted(ax, bx[i].max())))  # later ones begin beyond the block
        near = (ax[j] < bx[i, None]) & (ax[i, None] < bx[j]) & (low[i, None] <= high[j]) & (low[j] <= high[i, None]) & (i[:, None] < j)
        p, q = np.nonzero(near)
        p, q = i[p], j[q]
        turn = slope[p] - slope[q]
        p, q, turn = p[turn != 0], q[turn != 0], turn[turn != 0]
        x = ((ay[q] - slope[q] * ax[q]) - (ay[p] - slope[p] * ax[p])) / turn
        out.append(x[(x > np.maximum(ax[p], ax[q])) & (x < np.minimum(bx[p], bx[q]))])
    return np.concatenate(out) if out else np.zeros(0)


def swept(edges: np.ndarray, polygon: np.ndarray, role: np.ndarray, within: bool) -> float:
    """The covered area of one cell, from edges (ax, ay, bx, by) of numbered polygons."""
    return float(swept_each(edges, polygon, role, within, np.inf, 1)[0])


def swept_each(edges: np.ndarray, polygon: np.ndarray, role: np.ndarray, within: bool, stride: float, n: int) -> np.ndarray:
    """The covered areas of ``n`` cells that lie side by side, one in each ``stride`` along x."""
    back = edges[:, 0] > edges[:, 2]
    edges = np.where(back[:, None], edges[:, [2, 3, 0, 1]], edges)
    upright = edges[:, 0] == edges[:, 2]
    edges, polygon, role = edges[~upright], polygon[~upright], role[~upright]
    total = np.zeros(n)
    if not len(edges):
        return total
    cuts = np.unique(np.concatenate((edges[:, 0], edges[:, 2], crossings(edges))))
    ax, ay, bx, by = edges.T
    slope = (by - ay) / (bx - ax)
    first, last = np.searchsorted(cuts, ax), np.searchsorted(cuts, bx)
    # Strips are taken some at a time, so that the pieces of edges in them stay bounded.
    change = np.zeros(len(cuts), np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    pieces = np.cumsum(np.cumsum(change))
    start = 0
    while start < len(cuts) - 1:
        stop = max(start + 1, int(np.searchsorted(pieces, (pieces[start - 1] if start else 0) + PIECES)))
        stop = min(stop, len(cuts) - 1)
        strip, km2 = _strips(cuts, start, stop, edges, slope, first, last, polygon, role, within)
        total += np.bincount(np.floor(cuts[strip] / stride).astype(int), km2, n)
        start = stop
    return total


def _strips(cuts: np.ndarray, start: int, stop: int, edges: np.ndarray, slope: np.ndarray, first: np.ndarray, last: np.ndarray, polygon: np.ndarray, role: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """The covered bands in the strips from one cut to another: which strip, and their area."""
    low, high = np.maximum(first, start), np.minimum(last, stop)
    own = np.flatnonzero(low < high)
    times = (high - low)[own]
    edge = np.repeat(own, times)
    strip = np.arange(len(edge)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[own], times)
    x0, x1 = cuts[strip], cuts[strip + 1]
    y0, y1 = (edges[edge, 1] + slope[edge] * (x - edges[edge, 0]) for x in (x0, x1))
    # A polygon's edges in a strip, from below: into it and out of it in turn.
    order = np.lexsort((y0 + y1, polygon[edge], strip))
    fresh = np.concatenate(([True], (strip[order][1:] != strip[order][:-1]) | (polygon[edge][order][1:] != polygon[edge][order][:-1])))
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    sign = np.empty(len(order), np.int64)
    sign[order] = np.where(place % 2 == 0, 1, -1)
    # All edges of a strip, from below; every polygon is left again before the next strip.
    order = np.lexsort((y0 + y1, strip))
    sign, kind, strip, heights = sign[order], role[edge][order], strip[order], below(x0, y0, x1, y1)[order]
    depth = [np.cumsum(sign * (kind == k)) for k in range(3)]
    inside = (depth[0] > 0) & (depth[2] == 0) & ((depth[1] > 0) | (not within))
    inside = inside[:-1] & (strip[1:] == strip[:-1])
    return strip[:-1][inside], (heights[1:] - heights[:-1])[inside]


def ring_km2(ring: Column) -> Column:
    """Area of an open ring with the same integral, so that areas of parts add up to it."""
    n = F.size(ring)

    def term(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + 1, n))
        middle, half_way = F.radians((p["y"] + q["y"]) / 2), F.radians((q["y"] - p["y"]) / 2)
        return F.radians(q["x"] - p["x"]) * F.sin(middle) * F.when(half_way == 0, 1.0).otherwise(F.sin(half_way) / half_way)

    return F.abs(F.aggregate(F.transform(ring, term), F.lit(0.0), lambda a, t: a + t)) * F.lit(EARTH_KM**2)
