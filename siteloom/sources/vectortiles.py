"""Lines as vector tiles: cut to tiles, put on a tile's whole-number grid, encoded, and decoded by layer.

A tile is a message of layers, a layer one of features with shared keys and
values; geometry is a list of commands with zigzag differences. Features are
cut and encoded on their own in Arrow batches, so a shuffle brings a tile's
ready bytes together and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.proximity import spread_over

EXTENT = 4096
#: Fixed values of the format: field numbers of tile, layer, feature and value, and geometry commands.
LAYER, NAME, FEATURE, KEY, VALUE, EXTENT_FIELD, VERSION = 3, 1, 2, 3, 4, 5, 15
ID, TAGS, TYPE, GEOMETRY = 1, 2, 3, 4
INT_VALUE = 4
MOVE, LINE = 1, 2
LINES = 2  # the type of line features
SOME = 4096  # features that are Python objects at once


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message; what a field holds is not looked into."""
    data, at = memoryview(data).cast("B"), 0
    while at < len(data):
        key, at = read_varint(data, at)
        if key & 7 == 0:
            value, at = read_varint(data, at)
        elif key & 7 == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def varints(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = read_varint(data, at)
        out.append(value)
    return out


def commands(parts: list[np.ndarray]) -> bytes:
    """Lines of whole-number points as commands: a move to each line's start, then steps."""
    out, x, y = bytearray(), 0, 0
    zigzag = lambda n: varint(n << 1 if n >= 0 else -n * 2 - 1)
    for part in parts:
        for k, (u, v) in enumerate(part.tolist()):
            if k == 0:
                out += varint(1 << 3 | MOVE)
            elif k == 1:
                out += varint(len(part) - 1 << 3 | LINE)
            out += zigzag(u - x) + zigzag(v - y)
            x, y = u, v
    return bytes(out)


def lines_of(numbers: list[int]) -> list[list[tuple[int, int]]]:
    """The lines that commands draw."""
    out, x, y, at = [], 0, 0, 0
    while at < len(numbers):
        command, count = numbers[at] & 7, numbers[at] >> 3
        at += 1
        for _ in range(count if command in (MOVE, LINE) else 0):
            x += (numbers[at] >> 1) ^ -(numbers[at] & 1)
            y += (numbers[at + 1] >> 1) ^ -(numbers[at + 1] & 1)
            at += 2
            if command == MOVE:
                out.append([(x, y)])
            else:
                out[-1].append((x, y))
    return out


def cut_line(points: np.ndarray, size: float) -> list[np.ndarray]:
    """The pieces of a line inside the square from 0 to ``size``."""
    out: list[list[np.ndarray]] = []
    for p, q in zip(points, points[1:], strict=False):
        d, low, high = q - p, 0.0, 1.0
        for axis in (0, 1):
            if d[axis] == 0:
                if not 0 <= p[axis] <= size:
                    high = -1.0
                continue
            ends = sorted((-p[axis] / d[axis], (size - p[axis]) / d[axis]))
            low, high = max(low, ends[0]), min(high, ends[1])
        if low >= high:
            continue
        start, end = p + d * low if low > 0 else p, p + d * high if high < 1 else q
        if out and low == 0 and (out[-1][-1] == p).all():
            out[-1].append(end)
        else:
            out.append([start, end])
    return [np.array(x) for x in out]


def on_grid(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Pieces at whole numbers (halves up), without steps of no length; pieces that shrink to a point go."""
    out = []
    for part in parts:
        whole = np.floor(part + 0.5).astype(np.int64)
        kept = whole[np.concatenate(([True], (whole[1:] != whole[:-1]).any(axis=1)))]
        if len(kept) > 1:
            out.append(kept)
    return out


def tile_of(features: pa.Table, extent: int) -> bytes:
    """The message of one tile's features (layer, id, attrs, geometry). They stay in Arrow, but for some at a time."""
    own = features.select(["layer", "id", "attrs", "geometry"]).combine_chunks()
    order = pc.sort_indices(own, sort_keys=[(c, "ascending") for c in ("layer", "id", "geometry")])
    out, body = bytearray(), bytearray()
    name: str | None = None
    keys: dict[str, int] = {}
    values: dict[int, int] = {}

    def close() -> None:
        """Puts the layer that has been gathered into the tile."""
        nonlocal body
        body += b"".join(field(KEY, k.encode()) for k in keys) + b"".join(field(VALUE, field(INT_VALUE, v & (1 << 64) - 1)) for v in values) + field(EXTENT_FIELD, extent)
        head = field(VERSION, 2) + field(NAME, name.encode())
        out.extend(varint(LAYER << 3 | 2) + varint(len(head) + len(body)) + head)
        out.extend(body)
        body = bytearray()
        keys.clear()
        values.clear()

    for at in range(0, len(order), SOME):
        for r in own.take(order.slice(at, SOME)).to_pylist():
            if name is not None and r["layer"] != name:
                close()
            name = r["layer"]
            tags = b"".join(varint(keys.setdefault(a["key"], len(keys))) + varint(values.setdefault(a["value"], len(values))) for a in r["attrs"] or [] if a["value"] is not None)
            body += field(FEATURE, field(ID, r["id"]) + field(TAGS, tags) + field(TYPE, LINES) + field(GEOMETRY, r["geometry"]))
    if name is not None:
        close()
    return bytes(out)


def encode_tiles(lines: DataFrame, zoom: int, extent: int = EXTENT) -> DataFrame:
    """z, x, y and data: tiles of ``lines`` (id, layer, attrs: map of whole numbers, points: array of (lon, lat) as x and y).

    Lines without two points, or with a null one, are left out; latitudes lie within the map's.
    """
    scale = float(2**zoom)
    points = F.transform("points", lambda p: F.struct(((p["x"] + 180.0) / 360.0 * scale).alias("x"), ((1.0 - F.log(F.tan(F.radians(p["y"])) + 1.0 / F.cos(F.radians(p["y"]))) / math.pi) / 2.0 * scale).alias("y")))
    sound = lines.repartition(spread_over(lines)).where((F.size("points") > 1) & F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    placed = sound.select("id", "layer", "attrs", points.alias("points"))
    span = lambda axis: F.sequence(F.floor(F.array_min(F.transform("points", lambda p: p[axis]))), F.floor(F.array_max(F.transform("points", lambda p: p[axis]))))
    spread = placed.withColumn("x", F.explode(span("x"))).withColumn("y", F.explode(span("y"))).where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < scale) & (F.col("y") < scale))
    flat = spread.select("id", "layer", "x", "y", F.map_entries("attrs").alias("attrs"), F.transform("points", lambda p: (p["x"] - F.col("x")) * extent).alias("xs"), F.transform("points", lambda p: (p["y"] - F.col("y")) * extent).alias("ys"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, geometry = [], []
            for i, (xs, ys) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
                parts = on_grid(cut_line(np.stack([xs.values.to_numpy(), ys.values.to_numpy()], axis=1), float(extent)))
                if parts:
                    keep.append(i)
                    geometry.append(commands(parts))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("id", "layer", "x", "y", "attrs")), pa.array(geometry, pa.binary())], names=["id", "layer", "x", "y", "attrs", "geometry"])

    kinds = {f.name: f.dataType.simpleString() for f in flat.schema}
    cut = flat.mapInArrow(encode, f"id long, layer string, x long, y long, attrs {kinds['attrs']}, geometry binary")

    def gather(table: pa.Table) -> pa.Table:
        return pa.table({"z": pa.array([zoom], pa.int32()), "x": table.column("x")[:1], "y": table.column("y")[:1], "data": pa.array([tile_of(table, extent)], pa.binary())})

    return cut.groupBy("x", "y").applyInArrow(gather, "z int, x long, y long, data binary")


def decode_layer(data: memoryview) -> Iterator[dict]:
    """Features of one layer: id, attrs and lines."""
    keys, values = [], []
    for number, value in fields(data):  # they stand behind the features, which are gone through again
        if number == KEY:
            keys.append(bytes(value).decode())
        elif number == VALUE:
            whole = dict(fields(value))[INT_VALUE]
            values.append(whole - (1 << 64) if whole >> 63 else whole)
    for number, value in fields(data):
        if number != FEATURE:
            continue
        own = dict(fields(value))
        tags = varints(own.get(TAGS, memoryview(b"")))
        yield {"id": own.get(ID), "attrs": [(keys[k], values[v]) for k, v in zip(tags[::2], tags[1::2], strict=True)], "lines": [[{"x": x, "y": y} for x, y in line] for line in lines_of(varints(own.get(GEOMETRY, memoryview(b""))))]}


def decoded(tile: pa.BinaryScalar, wanted: dict[bytes, str]) -> list[pa.RecordBatch]:
    """layer, id, attrs and lines of a tile's features, which become Arrow some at a time; nothing of a tile that is null or broken."""
    kinds = {"layer": pa.string(), "id": pa.int64(), "attrs": pa.map_(pa.string(), pa.int64()), "lines": pa.list_(pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))}
    out: list[pa.RecordBatch] = []
    try:
        for number, layer in fields(tile.as_buffer()) if tile.is_valid else ():
            name = next((bytes(v) for n, v in fields(layer) if n == NAME), b"") if number == LAYER else b""
            if name not in wanted:
                continue
            features = decode_layer(layer)
            while some := list(islice(features, SOME)):
                out.append(pa.RecordBatch.from_arrays([pa.array([wanted[name]] * len(some) if c == "layer" else [f[c] for f in some], kind) for c, kind in kinds.items()], names=list(kinds)))
    except (IndexError, KeyError, ValueError, TypeError):
        return []
    return out


def decode_tiles(tiles: DataFrame, layers: list[str]) -> DataFrame:
    """z, x, y, layer, id, attrs and lines of the features of ``layers``; other layers are passed over unread. A tile that is null or broken holds nothing."""
    wanted = {name.encode(): name for name in layers}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                for found in decoded(own.column("data")[0], wanted):
                    place = own.select(["z", "x", "y"]).take(pa.array(np.zeros(found.num_rows, np.int64)))
                    yield pa.RecordBatch.from_arrays([*place.columns, *found.columns], names=["z", "x", "y", *found.schema.names])

    return tiles.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "data").mapInArrow(decode, "z int, x long, y long, layer string, id long, attrs map<string, long>, lines array<array<struct<x: long, y: long>>>")
