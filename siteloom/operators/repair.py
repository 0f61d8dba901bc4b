"""Making polygons valid: what lies in an odd number of a polygon's rings stays, as simple rings.

Edges are cut where they meet. Of pieces that lie on each other, pairs cancel.
Every piece that is left has an odd side and an even one; walking pieces with
the odd side on the left, by the sharpest turn at each corner, gives the
outlines of what stays. Outlines that touch themselves are parted there. What
runs counter-clockwise is an outside, the rest are holes of the smallest
outside around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.operators.coverage import following
from siteloom.operators.proximity import spread_over

POINT = "struct<x: double, y: double>"
RINGS, POLYGONS = f"array<array<{POINT}>>", f"array<array<array<{POINT}>>>"
DIGITS = 10  # decimals that corners are kept to
SHORT = 256  # edges of a polygon up to which it is mended together with others
PAIRS = 1 << 19  # of edges of polygons that are mended together, about


def _near(edges: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges whose boxes meet, found block by block."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]) - 1e-12, np.maximum(edges[:, :2], edges[:, 2:])
    found = []
    for at in range(0, len(edges), block):
        own = slice(at, at + block)
        near = (low[own, None, 0] <= high[:, 0]) & (low[:, 0] <= high[own, None, 0]) & (low[own, None, 1] <= high[:, 1]) & (low[:, 1] <= high[own, None, 1])
        i, j = np.nonzero(near)
        found.append(np.stack((i + at, j))[:, i + at < j])
    i, j = np.concatenate(found, axis=1)
    return i, j


def _near_each(edges: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the edges of many polygons, which stand in order, within each."""
    first = np.searchsorted(of, of, side="right")
    later = first - np.arange(len(of)) - 1
    i = np.repeat(np.arange(len(of)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    low, high = np.minimum(edges[:, :2], edges[:, 2:]) - 1e-12, np.maximum(edges[:, :2], edges[:, 2:])
    near = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
    return i[near], j[near]


def _odd_above(edges: np.ndarray, middles: np.ndarray, block: int = 512) -> np.ndarray:
    """For each middle (of the edge at its place), whether an odd number of other edges lies above it."""
    ax, ay, bx, by = edges.T
    low, high = np.minimum(ax, bx), np.maximum(ax, bx)
    out = []
    for at in range(0, len(middles), block):
        x, y = middles[at : at + block].T
        with np.errstate(divide="ignore", invalid="ignore"):
            heights = ay + (by - ay) * ((x[:, None] - ax) / (bx - ax))
        over = (low <= x[:, None]) & (x[:, None] < high) & (heights > y[:, None])
        over[np.arange(len(x)), at + np.arange(len(x))] = False
        out.append(over.sum(axis=1) % 2 == 1)
    return np.concatenate(out)


def _odd_over(edges: list[tuple], k: int, flip: bool, whole: np.ndarray | None) -> bool:
    """Whether an odd number of other edges lies above the middle of an edge, or beside it on the high side of x where ``flip``."""
    if whole is not None:
        own = whole[:, [1, 0, 3, 2]] if flip else whole
        return bool(_odd_above(np.concatenate((own[[k]], np.delete(own, k, axis=0))), own[[k], :2] / 2 + own[[k], 2:] / 2)[0])
    p, q, u, v = edges[k]
    x, y = (q / 2 + v / 2, p / 2 + u / 2) if flip else (p / 2 + u / 2, q / 2 + v / 2)
    odd = False
    for n, (ax, ay, bx, by) in enumerate(edges):
        if flip:
            ax, ay, bx, by = ay, ax, by, bx
        if (ax <= x < bx or bx <= x < ax) and n != k and ay + (by - ay) * ((x - ax) / (bx - ax)) > y:
            odd = not odd
    return odd


def _odd_on_the_left(edges: list[tuple]) -> list[tuple]:
    """``edges`` turned so that the odd side is on their left.

    Around a corner the sides alternate, so one piece's direction gives those of
    all pieces that it hangs together with; the longest of them is looked up.
    """
    whole = np.array(edges) if len(edges) > SHORT else None
    ends: dict[tuple, list[tuple[float, int, bool]]] = {}
    for k, (x, y, u, v) in enumerate(edges):
        ends.setdefault((x, y), []).append((math.atan2(v - y, u - x), k, True))
        ends.setdefault((u, v), []).append((math.atan2(y - v, x - u), k, False))
    for around in ends.values():
        around.sort()
    longest = sorted(range(len(edges)), key=lambda k: -math.hypot(edges[k][2] - edges[k][0], edges[k][3] - edges[k][1]))
    forward: dict[int, bool] = {}
    for first in longest:
        if first in forward:
            continue
        x, y, u, v = edges[first]
        flip = abs(u - x) < abs(v - y)  # look along the other axis for steep ones
        rising = v > y if flip else u > x
        # Left of a piece to the right is above it; left of a piece upwards is not right of it.
        forward[first] = (_odd_over(edges, first, flip, whole) == rising) != flip
        todo = [(x, y), (u, v)]
        while todo:
            around = ends[todo.pop()]
            at = next(i for i, (_, k, _) in enumerate(around) if k in forward)
            leaves = forward[around[at][1]] == around[at][2]
            for i, (_, k, starts) in enumerate(around):
                if k not in forward:
                    forward[k] = (leaves if (i - at) % 2 == 0 else not leaves) == starts
                    todo.append(edges[k][2:] if starts else edges[k][:2])
    return [e if forward[k] else (*e[2:], *e[:2]) for k, e in enumerate(edges)]


def noded(edges: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (ax, ay, bx, by) of the polygons ``of``, in order, cut at all points where two of a polygon meet, each piece in a fixed direction; repeated until nothing is cut. With the pieces' polygons."""
    for _ in range(8):
        a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
        i, j = _near(edges) if of[0] == of[-1] else _near_each(edges, of)
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        gap = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = ((gap[:, 0] * d[k, 1] - gap[:, 1] * d[k, 0]) / cross for k in (j, i))
        hit = (np.abs(cross) > 1e-18) & (s > -1e-12) & (s < 1 + 1e-12) & (t > -1e-12) & (t < 1 + 1e-12)
        points = np.round(a[i[hit]] + d[i[hit]] * s[hit, None], DIGITS)
        for end in (edges[i[hit], :2], edges[i[hit], 2:], edges[j[hit], :2], edges[j[hit], 2:]):
            points = np.where((np.abs(points - end) < 3 * 10.0**-DIGITS).all(axis=1)[:, None], end, points)
        owners, places = [i[hit], j[hit]], [points, points]
        # Corners on other edges, of edges on one line too.
        for end in (edges[:, :2], edges[:, 2:]):
            for p, q in ((i, j), (j, i)):
                off = end[q] - a[p]
                length = (d[p] ** 2).sum(axis=1)
                at = (off * d[p]).sum(axis=1) / length
                on = (np.abs(off[:, 0] * d[p, 1] - off[:, 1] * d[p, 0]) <= 1e-10 * np.sqrt(length)) & (at > 0) & (at < 1)
                owners.append(p[on])
                places.append(end[q][on])
        # Every edge's ends and the cuts between them, in order along it.
        n, squares = len(edges), (d**2).sum(axis=1)
        owner, place = np.concatenate(owners), np.concatenate(places)
        along = ((place - a[owner]) * d[owner]).sum(axis=1) / squares[owner]
        between = (along > 0) & (along < 1)
        owner = np.concatenate((np.arange(n), np.arange(n), owner[between]))
        place = np.concatenate((edges[:, :2], edges[:, 2:], place[between])) + 0.0
        along = np.concatenate((np.full(n, -1.0), np.full(n, 2.0), along[between]))
        order = np.lexsort((place[:, 1], place[:, 0], along, owner))
        owner, place = owner[order], place[order]
        same = (owner[1:] == owner[:-1]) & (place[1:] != place[:-1]).any(axis=1)
        cut = np.concatenate((place[:-1][same], place[1:][same]), axis=1)
        if len(cut) == n:
            break
        edges, of = cut, of[owner[1:][same]]
    back = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
    return np.where(back[:, None], edges[:, [2, 3, 0, 1]], edges), of


def outlines(edges: list[tuple]) -> list[list[tuple[float, float]]]:
    """Simple closed outlines, the odd side on the left, along edges that each stand once."""
    directed = _odd_on_the_left(edges)
    out: dict[tuple, list[tuple[float, int]]] = {}
    for k, (x, y, u, v) in enumerate(directed):
        out.setdefault((x, y), []).append((math.atan2(v - y, u - x), k))
    left, found = set(range(len(directed))), []
    for first in range(len(directed)):
        k = first
        path: list[tuple] = []
        seen: dict[tuple, int] = {}
        while k in left:
            left.discard(k)
            start, end = directed[k][:2], directed[k][2:]
            if start in seen:  # the outline touches itself: what it went around is an outline of its own
                at = seen[start]
                found.append(path[at:])
                for p in path[at:]:
                    del seen[p]
                del path[at:]
            seen[start] = len(path)
            path.append(start)
            after = out.get(end, ())
            if len(after) == 1:
                k = after[0][1]
            elif after:
                back = math.atan2(start[1] - end[1], start[0] - end[0])
                k = min(((back - angle) % (2 * math.pi) or 2 * math.pi, n) for angle, n in after)[1]
        found.append(path)
    return [r for r in found if len(r) > 2]


def signed_area(ring: np.ndarray | list[tuple[float, float]]) -> float:
    (x0, y0), total = ring[0], 0.0
    px, py = ring[-1][0] - x0, ring[-1][1] - y0
    for x, y in ring:
        x, y = x - x0, y - y0
        total += px * y - x * py
        px, py = x, y
    return float(total / 2)


def holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    inside, (x0, y0) = False, ring[-1]
    for x1, y1 in ring:
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x0 - x1) * (p[1] - y1) / (y0 - y1) + x1:
            inside = not inside
        x0, y0 = x1, y1
    return inside


def _nested(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Outlines as polygons, each its outside and its holes, largest first."""
    areas = [(signed_area(r), r) for r in rings]
    areas.sort(key=lambda a: -abs(a[0]))
    outer = [[r] for size, r in areas if size > 0]
    for hole in (r for size, r in areas if size < 0):
        (x, y), (u, v) = hole[:2]
        length = math.hypot(v - y, x - u)
        step = min(1e-9, length / 4) / length
        inner = ((x + u) / 2 + (v - y) * step, (y + v) / 2 + (x - u) * step)  # just within the hole, right of its edge
        around = [o for o in outer if holds(o[0], inner)]
        if around:
            around[-1].append(hole)  # the smallest, as they stand by falling area
    return outer


def mended(x: np.ndarray, y: np.ndarray, ring: np.ndarray, of: np.ndarray, n: int) -> list[list[list[list[tuple[float, float]]]]]:
    """Valid polygons for each of ``n`` polygons, from the corners of their rings; ``of`` tells the polygon of each ring, both in order.

    Those with a corner that is no number have none. Short ones are cut together.
    """
    x, y = (np.round(c, DIGITS) + 0.0 for c in (x, y))
    after = following(ring)
    edges = np.stack((x, y, x[after], y[after]), axis=1)
    bad = np.bincount(of[ring[~np.isfinite(edges).all(axis=1)]], minlength=n) > 0
    kept = (np.bincount(ring, minlength=len(of)) > 2)[ring] & ~bad[of[ring]] & (edges[:, :2] != edges[:, 2:]).any(axis=1)
    edges, own = edges[kept], of[ring[kept]]
    count = np.bincount(own, minlength=n)
    ends = np.cumsum(count)
    weight = np.cumsum(np.where(count > SHORT, PAIRS, count * count))
    out: list[list] = [[] for _ in range(n)]
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(weight, (weight[start - 1] if start else 0) + PAIRS)))
        part = slice(ends[start] - count[start], ends[stop - 1])
        if part.start < part.stop:
            pieces, polygon = noded(edges[part], own[part])
            order = np.lexsort((*pieces.T[::-1], polygon))
            pieces, polygon = pieces[order], polygon[order]
            new = np.concatenate(([True], (pieces[1:] != pieces[:-1]).any(axis=1) | (polygon[1:] != polygon[:-1])))
            times = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
            odd = np.flatnonzero(new)[times % 2 == 1]
            rows, bounds = list(map(tuple, pieces[odd].tolist())), np.searchsorted(polygon[odd], np.arange(start, stop + 1)).tolist()
            for k in range(stop - start):
                if bounds[k] < bounds[k + 1]:
                    out[start + k] = _nested(outlines(rows[bounds[k] : bounds[k + 1]]))
        start = stop
    return out


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Valid polygons, each its outside and its holes, largest first."""
    points = np.concatenate([np.zeros((0, 2)), *rings])
    found = mended(points[:, 0], points[:, 1], np.repeat(np.arange(len(rings)), [len(r) for r in rings]).astype(int), np.zeros(len(rings), int), 1)[0]
    return [[np.array(r) for r in p] for p in found]


def repaired(df: DataFrame, rings: str) -> DataFrame:
    """``df`` with ``polygons``, the valid form of the polygon whose rings (arrays of (x, y), open or closed) ``rings`` holds.

    Rows whose polygon is null, has no area or a corner without coordinates get an empty list.
    """
    kept = [c for c in df.columns if c != "polygons"]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("polygons", T._parse_datatype_string(POLYGONS))])
    at = kept.index(rings)

    def lengths(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def lists(counts: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(at)
            own = whole.flatten()
            x, y = (pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False) for c in own.flatten().flatten())
            of = np.repeat(np.arange(batch.num_rows), lengths(whole))
            found = mended(x, y, np.repeat(np.arange(len(of)), lengths(own)), of, batch.num_rows)
            flat = list(chain.from_iterable(found))
            rings_of = list(chain.from_iterable(flat))
            points = np.array(list(chain.from_iterable(rings_of)), float).reshape(-1, 2)
            corners = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
            out = lists(list(map(len, found)), lists(list(map(len, flat)), lists(list(map(len, rings_of)), corners)))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=schema.names)

    # A polygon is small to read and much work, so the rows are dealt over tasks first.
    return df.select(*kept).repartition(spread_over(df)).mapInArrow(mend, schema)


def valid_rows(df: DataFrame, rings: str) -> DataFrame:
    """The rows of ``df`` whose polygon has an area, with ``polygons``: what a load keeps."""
    return repaired(df, rings).where(F.size("polygons") > 0)
