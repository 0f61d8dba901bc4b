"""Tiled rasters against brute force on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.operators import rasters
from siteloom.plans.grids import reproject
from siteloom.sources import rasters as stored

SIDE = 8


def to_tiles(spark, array, dtype="uint8", fill=0):
    rows, cols = np.indices(array.shape)
    pixels = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(rows.ravel(), cols.ravel(), array.ravel(), strict=True) if v != fill and not (fill != fill and v != v)], "row int, col int, value double")
    return rasters.tiles_of(pixels, SIDE, dtype, fill)


def to_array(tiles, shape, dtype="uint8", fill=0.0):
    out = np.full(shape, fill)
    for r in rasters.pixels_of(tiles, SIDE, dtype, *shape).collect():
        out[r["row"], r["col"]] = r["value"]
    return out


def brute_closed(mask, radius):
    h, w = mask.shape
    wide = np.zeros((h + 2 * radius, w + 2 * radius), bool)
    for i, j in rasters.disk(radius):
        wide[radius + i : radius + i + h, radius + j : radius + j + w] |= mask
    inner = np.zeros_like(wide)
    inner[radius:-radius, radius:-radius] = wide[radius:-radius, radius:-radius]
    return np.logical_and.reduce([inner[radius + i : radius + i + h, radius + j : radius + j + w] for i, j in rasters.disk(radius)])


def brute_filled(mask):
    h, w = mask.shape
    seen, todo = np.zeros_like(mask), [(r, c) for r in range(h) for c in range(w) if (r in (0, h - 1) or c in (0, w - 1)) and not mask[r, c]]
    while todo:
        r, c = todo.pop()
        if 0 <= r < h and 0 <= c < w and not mask[r, c] and not seen[r, c]:
            seen[r, c] = True
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return ~seen


@pytest.mark.parametrize(("shape", "share", "radius"), [((30, 21), 0.2, 2), ((17, 40), 0.05, 3), ((8, 8), 0.5, 1)])
def test_closing_equals_brute_force(spark, shape, share, radius):
    mask = np.random.default_rng(radius).random(shape) < share
    assert (to_array(rasters.closed(to_tiles(spark, mask), radius, SIDE, *shape), shape) == brute_closed(mask, radius)).all()


def test_holes_across_many_tiles_are_filled(spark):
    mask = np.zeros((45, 50), bool)
    mask[3, 2:44] = mask[40, 2:44] = mask[3:41, 2] = mask[3:41, 43] = True  # a ring around tiles without a pixel
    mask[20, 10:30] = True
    mask[20:30, 10] = mask[30, 10:30] = mask[20:31, 30] = True
    mask[0:5, 47] = True
    mask[24, 30] = False  # the inner ring is open, the outer one is not
    tiles = rasters.filled(to_tiles(spark, mask), SIDE, *mask.shape)
    assert (to_array(tiles, mask.shape) == brute_filled(mask)).all()
    mask[3, 20] = False
    assert (to_array(rasters.filled(to_tiles(spark, mask), SIDE, *mask.shape), mask.shape) == brute_filled(mask)).all()


@pytest.mark.parametrize("seed", range(3))
def test_random_masks_are_filled_as_by_brute_force(spark, seed):
    mask = np.random.default_rng(seed).random((33, 27)) < 0.55
    want = brute_filled(mask)
    assert want.sum() > mask.sum()
    assert (to_array(rasters.filled(to_tiles(spark, mask), SIDE, *mask.shape), mask.shape) == want).all()


def test_stricter_classes_claim_first(spark):
    rng = np.random.default_rng(5)
    masks = [rng.random((20, 20)) < 0.3 for _ in range(3)]
    want = np.where(masks[0], 1, np.where(masks[1], 2, np.where(masks[2], 3, 0)))
    assert (to_array(rasters.claimed([to_tiles(spark, m) for m in masks], SIDE), (20, 20)) == want).all()


@pytest.mark.parametrize(("shape", "free"), [((40, 33), 0.02), ((25, 60), 0.3), ((64, 16), 0.001), ((9, 9), 0.0)])
def test_distances_equal_brute_force(spark, shape, free):
    rng = np.random.default_rng(int(free * 1000))
    mask = rng.random(shape) >= free
    r, c = np.nonzero(~mask)
    rows, cols = np.indices(shape)
    want = np.min((rows[..., None] - r) ** 2 + (cols[..., None] - c) ** 2, axis=2).astype(float) if len(r) else np.full(shape, np.inf)
    assert (to_array(rasters.squared_distances(to_tiles(spark, mask), SIDE, *shape), shape, "float64") == want).all()


def raster(spark, tmp_path, shape=(37, 29), name="a", **grid):
    array = np.random.default_rng(1).random(shape).astype(np.float32)
    array[8:16, 16:24] = np.nan  # one whole block
    path = str(tmp_path / name)
    stored.write_raster(to_tiles(spark, array, "float32", float("nan")), path, SIDE, *shape, **grid)
    return array, path


@pytest.mark.parametrize("window", [(0, 37, 0, 29), (8, 16, 8, 16), (7, 17, 15, 25), (-5, 3, 20, 99), (10, 10, 0, 5), (36, 37, 28, 29)])
def test_windows_equal_slices(spark, tmp_path, window):
    array, path = raster(spark, tmp_path)
    top, bottom, left, right = max(0, window[0]), min(37, window[1]), max(0, window[2]), min(29, window[3])
    got = np.full((max(0, bottom - top), max(0, right - left)), -1.0, np.float32)
    for r in stored.read_window(spark, path, window).collect():
        got[r["row"] - top, r["col"] - left] = r["value"]
    assert np.array_equal(got, array[top:bottom, left:right], equal_nan=True)
    asked = spark.createDataFrame([("w", *window)], "name string, top int, bottom int, left int, right int")
    many = stored.read_windows(spark, path, asked).collect()
    assert len(many) == got.size and all(np.array_equal(np.float32(r["value"]), array[r["row"], r["col"]], equal_nan=True) for r in many)


def test_only_blocks_that_meet_the_window_are_opened(spark, tmp_path):
    _, path = raster(spark, tmp_path)
    frame = stored.read_window(spark, path, (7, 17, 8, 9))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan
    frame.write.format("noop").mode("overwrite").save()
    opened = spark.read.schema("data binary, ty int, tx int").parquet(path).where("ty BETWEEN 0 AND 2 AND tx BETWEEN 1 AND 1").select(F.input_file_name().alias("f")).distinct().count()
    scan = [line for line in plan.split("\n") if "PartitionFilters" in line][0]
    assert opened == 3 and "(ty" in scan and "(tx" in scan
    metrics = frame._jdf.queryExecution().executedPlan()
    found, todo = [], [metrics]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "QueryStageExec" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if node.metrics().contains("numFiles"):
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert found == [3]


def test_windows_too_large_and_foreign_grids_are_errors(spark, tmp_path, monkeypatch):
    _, a = raster(spark, tmp_path)
    _, b = raster(spark, tmp_path, name="b")
    _, c = raster(spark, tmp_path, name="c", step=0.5)
    assert stored.same_grid(spark, [a, b])["side"] == SIDE
    with pytest.raises(ValueError, match="another grid"):
        stored.same_grid(spark, [a, b, c])
    monkeypatch.setattr(stored, "MOST_PIXELS", 100)
    with pytest.raises(ValueError, match="100 is the most"):
        stored.read_window(spark, a, (0, 37, 0, 29))
    asked = spark.createDataFrame([(0, 37, 0, 29)], "top int, bottom int, left int, right int")
    with pytest.raises(Exception, match="too many pixels"):
        stored.read_windows(spark, a, asked).collect()


def test_reprojection_equals_a_plain_loop(spark):
    import math

    rng = np.random.default_rng(3)
    side, zoom = 4, 6
    rows = [(tx, ty, px, py, None if rng.random() < 0.2 else float(rng.random()), turn) for turn in (1, 2) for tx in (45, 46) for ty in (27, 28) for px in range(side) for py in range(side) if turn == 1 or rng.random() < 0.3]
    tiles = spark.createDataFrame(rows, "tx long, ty long, px long, py long, value double, turn long")
    last = {}
    for tx, ty, px, py, v, turn in sorted(rows, key=lambda r: r[5]):
        last[(tx * side + px, ty * side + py)] = v  # a later tile counts even where it has no value
    nodes = [(i, 73.0 + 0.2 * i, 20.0 + 0.07 * (i % 50)) for i in range(90)]
    got = {r["i"]: r["value"] for r in reproject(tiles, spark.createDataFrame(nodes, "i int, lon double, lat double"), zoom, side).collect()}
    for i, lon, lat in nodes:
        x = (lon + 180) / 360 * 2**zoom * side - 0.5
        y = (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 2**zoom * side - 0.5
        total = weight = 0.0
        for a in (math.floor(x), math.floor(x) + 1):
            for b in (math.floor(y), math.floor(y) + 1):
                v, w = last.get((a, b)), (1 - abs(x - a)) * (1 - abs(y - b))
                if v is not None:
                    total, weight = total + v * w, weight + w
        assert (i in got) == (weight > 0)
        assert weight == 0 or abs(got[i] - total / weight) < 1e-9
    assert 10 < len(got) < 90
