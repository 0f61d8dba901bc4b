"""Vector tiles and tile archives: round trips, and what is opened."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from siteloom.sources import tilearchive, vectortiles

LINE = "id long, layer string, attrs map<string, long>, points array<struct<x: double, y: double>>"


def to_tile(lon, lat, zoom):
    return (lon + 180) / 360 * 2**zoom, (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 2**zoom


def random_lines(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(70, 90), rng.uniform(8, 35)
        points = [(x, y)]
        for _ in range(rng.randrange(1, 8)):
            points.append((points[-1][0] + rng.uniform(-2, 2), points[-1][1] + rng.uniform(-2, 2)))
        out.append((i, ["a", "b", "c"][i % 3], {"voltage": rng.randrange(-5, 800), "n": i} if i % 4 else None, points))
    return out


def test_lines_come_back_at_tile_precision(spark):
    rows = random_lines(60) + [(900, "a", None, [(70.0, 10.0)]), (901, "a", {}, None), (902, "a", {}, [(75.0, 10.0), (75.0, 10.0)]), (903, "b", {"voltage": 1 << 40}, [(75.0, 10.0), (75.0, 20.0)])]
    zoom = 5
    tiles = vectortiles.encode_tiles(spark.createDataFrame(rows, LINE), zoom)
    got = {}
    for r in vectortiles.decode_tiles(tiles, ["a", "b", "c"]).collect():
        source = next(x for x in rows if x[0] == r["id"])
        assert r["layer"] == source[1] and r["attrs"] == (source[2] or {})
        for line in r["lines"]:
            assert len(line) > 1 and all(0 <= p["x"] <= 4096 and 0 <= p["y"] <= 4096 for p in line)
        got.setdefault(r["id"], []).append((r["x"], r["y"], [[(p["x"], p["y"]) for p in line] for line in r["lines"]]))
    assert set(got) == {r[0] for r in rows} - {900, 901, 902}
    for name, _, _, points in rows[:60] + rows[-1:]:
        path = np.array([to_tile(*p, zoom) for p in points])
        whole = sum(np.hypot(*(b - a)) for a, b in zip(path, path[1:], strict=False))
        pieces = [(np.array(line, float) / 4096 + (x, y)) for x, y, lines in got[name] for line in lines]
        assert abs(sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in pieces) - whole) < 1e-3 * len(points) * (1 + whole)
        # Every point of the input that is in a tile's inside is a point of its pieces, and the other way round every piece lies on the line.
        for p in path:
            assert min(np.hypot(*(q - p)) for piece in pieces for q in piece) < 2e-4
        for piece in pieces:
            for q in piece:
                t = [np.clip(((q - a) @ (b - a)) / max((b - a) @ (b - a), 1e-18), 0, 1) for a, b in zip(path, path[1:], strict=False)]
                assert min(np.hypot(*(a + (b - a) * s - q)) for (a, b), s in zip(zip(path, path[1:], strict=False), t, strict=False)) < 3e-4


def test_only_the_layers_asked_for_are_decoded(spark, monkeypatch):
    tiles = vectortiles.encode_tiles(spark.createDataFrame(random_lines(30), LINE), 3)
    row = tiles.orderBy(F.octet_length("data").desc()).first()
    read = []
    monkeypatch.setattr(vectortiles, "decode_layer", lambda data: read.append(bytes(data)) or iter(()))
    names = [bytes(v) for n, layer in vectortiles.fields(bytes(row["data"])) if n == vectortiles.LAYER for m, v in vectortiles.fields(layer) if m == vectortiles.NAME]
    assert names == [b"a", b"b", b"c"]
    assert {r["layer"] for r in vectortiles.decode_tiles(tiles, ["b", "x"]).collect()} <= {"b"}
    monkeypatch.undo()
    assert {r["layer"] for r in vectortiles.decode_tiles(tiles, ["b", "x"]).collect()} == {"b"}
    # A layer that is not asked for may be broken.
    broken = spark.createDataFrame([(3, 1, 1, bytearray(vectortiles.field(3, vectortiles.field(1, b"a") + b"\x12\x7f") + bytes(row["data"]))), (3, 2, 2, bytearray(b"\x1a\xff")), (3, 2, 3, None)], "z int, x long, y long, data binary")
    found = vectortiles.decode_tiles(broken, ["b"]).collect()
    assert {(r["x"], r["y"]) for r in found} == {(1, 1)}


def test_a_message_by_hand():
    """The example of the format: a line from (2, 2) over (2, 10) to (10, 10)."""
    assert vectortiles.commands([np.array([(2, 2), (2, 10), (10, 10)])]) == bytes([9, 4, 4, 18, 0, 16, 16, 0])
    assert vectortiles.lines_of([9, 4, 4, 18, 0, 16, 16, 0]) == [[(2, 2), (2, 10), (10, 10)]]
    assert vectortiles.varint(300) == b"\xac\x02" and vectortiles.varints(memoryview(b"\xac\x02\x01")) == [300, 1]


def test_ids_run_along_a_curve(spark):
    for z in (0, 1, 3):
        n = 2**z
        rows = spark.range(n * n).select(F.lit(z).alias("z"), F.floor(F.col("id") / n).alias("x"), F.pmod("id", F.lit(n)).alias("y")).withColumn("id", tilearchive.tile_id("z", "x", "y")).orderBy("id").collect()
        first = (4**z - 1) // 3
        assert [r["id"] for r in rows] == list(range(first, first + n * n))
        assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:], strict=False))
        assert (rows[0]["x"], rows[0]["y"]) == (0, 0) and (rows[-1]["x"], rows[-1]["y"]) == (n - 1, 0)


def test_archive_reads_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tilearchive, "LEAF_BITS", 4)
    monkeypatch.setattr(tilearchive, "FOLDER_LEAVES", 2)
    monkeypatch.setattr(tilearchive, "PART_BYTES", 500)
    z = 5
    rows = [(z, x, y, bytearray(b"sea" * 20) if (x + y) % 3 or y > 16 else bytearray(f"{x}/{y}".encode() * 20)) for x in range(32) for y in range(32) if not 8 <= x < 12] + [(2, 1, 1, bytearray(b"low")), (2, 3, 3, None)]
    path = str(tmp_path / "archive")
    tilearchive.write_archive(spark.createDataFrame(rows, "z int, x long, y long, data binary"), path)
    payloads, leaves = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/leaves")
    assert payloads.count() == len({bytes(r[3]) for r in rows if r[3] is not None})  # equal payloads once
    assert leaves.select(F.explode("entries")).count() < len(rows) / 2  # runs
    whole = spark.createDataFrame([r[:3] for r in rows] + [(z, 9, 9), (4, 0, 0)], "z int, x long, y long")
    back = {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in tilearchive.read_tiles(spark, path, whole).collect()}
    assert back == {r[:3]: bytes(r[3]) for r in rows if r[3] is not None}
    asked = spark.createDataFrame([(z, 0, 0), (z, 0, 0), (z, 0, 3), (z, 9, 9)], "z int, x long, y long")
    found = tilearchive.read_tiles(spark, path, asked)
    assert {(r["x"], r["y"]) for r in found.collect()} == {(0, 0), (0, 3)}
    opened = files_read(tilearchive.read_tiles(spark, path, asked))
    parts = payloads.select("part").distinct().count()
    assert parts > 10 and 0 < opened["payloads"] <= 2


def files_read(frame):
    """Files opened for payloads and for the rest, by the scans of an executed plan."""
    frame.collect()
    out, todo = {}, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif "QueryStageExec" in kind:
            todo.append(node.plan())
        else:
            if node.metrics().contains("numFiles"):
                name = "payloads" if "data#" in node.toString() and "part#" in node.toString() else "other"
                out[name] = out.get(name, 0) + node.metrics().apply("numFiles").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out
