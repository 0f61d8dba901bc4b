"""Steps that the third round's findings name, by the work they do and held to their plain form."""

import numpy as np

from tests.test_queries import DATA, pytestmark, rows  # noqa: F401
from tests.test_round3 import MANY_MASTS, keyed, same  # noqa: F401


def test_many_rings_are_cut_as_each_on_its_own():
    from siteloom.operators.coverage import _cells, _filled, _half, _pieces, fills
    from siteloom.plans.zones import SHAPES

    rings = [[(70 + i * 0.137 + a, 20 - i * 0.071 + b) for a, b in SHAPES[i % 2]] for i in range(20)]
    want = {(i, cx, cy): (sorted(p), fills(p, cx, cy, 0.1)) for i, r in enumerate(rings) for cx, cy, p in _pieces(r, 0.1, _half)}
    x, y = (np.array([p[k] for r in rings for p in r]) for k in (0, 1))
    owner, cx, cy, x, y, piece = _cells(x, y, np.repeat(np.arange(20), 5), 20, 0.1)
    whole, some = _filled(x, y, piece, cx, cy, 0.1)
    got = {(owner[k], cx[k], cy[k]): (sorted(zip(x[piece == k].tolist(), y[piece == k].tolist(), strict=True)), True if whole[k] else False if some[k] else None) for k in range(len(owner))}
    assert got == want


def test_crowded_windows_are_swept_in_parts(monkeypatch):
    """Of a window with many zones, parts that one of them fills are not swept, and the area is the same."""
    from siteloom.operators import coverage

    rng, n = np.random.default_rng(3), 40
    corners = [(np.array([0.0, 0.1, 0.1, 0.0]), np.array([0.0, 0.0, 0.1, 0.08])), *((0.1 * rng.random(4), 0.1 * rng.random(4)) for _ in range(n - 1))]
    x, y, ring = (np.concatenate(c) for c in (*zip(*corners, strict=True), [np.repeat(i, 4) for i in range(n)]))
    of = lambda: coverage.covered_each(x, y, ring, np.zeros(n, int), np.arange(n) < 1, np.zeros(1, int), 0.1)
    swept, sizes = coverage.swept_each, []
    monkeypatch.setattr(coverage, "swept_each", lambda edges, *more: sizes.append(len(edges)) or swept(edges, *more))
    parts = of()
    monkeypatch.setattr(coverage, "FEW", n)
    whole = of()
    assert abs(parts[0] - whole[0]) < 1e-9 and whole[0] > 0 and len(sizes) > 2


def test_a_filled_cell_brings_no_other_pieces(spark):
    from siteloom.operators.coverage import _dealt_zones

    square = lambda x, r: f"array({x - r}D, {x + r}D, {x + r}D, {x - r}D) AS xs, array(-{r}D, -{r}D, {r}D, {r}D) AS ys"
    rings = spark.sql(" UNION ALL ".join(f"SELECT array(named_struct('layer', 'a'), named_struct('layer', '{b}')) AS groups, {square(x, r)}" for b, x, r in (("b", 0, 1.05), ("c", 0.02, 0.97)))).coalesce(1)
    got = {}
    for r in _dealt_zones(rings, "groups", 0.1).collect():
        got.setdefault((r["group"]["layer"], r["cx"], r["cy"]), []).append(r["whole"])
    assert got["a", 9, 0] == [True] and got["b", 9, 0] == [True] and got["c", 9, 0] == [False]
    assert got["a", 0, 0] == [True] and got["a", 10, 0] == [False]


def test_polygons_are_mended_together_as_each_on_its_own(spark, same, monkeypatch):
    from siteloom.operators import repair

    rng = np.random.default_rng(4)
    many = [[rng.integers(0, 6, (int(rng.integers(0, 9)), 2)).astype(float) for _ in range(k % 3 + 1)] for k in range(60)]
    alone = [[[r.tolist() for r in p] for p in repair.polygons(m)] for m in many]
    calls, noded = [], repair.noded
    monkeypatch.setattr(repair, "noded", lambda *own: calls.append(1) or noded(*own))
    flat = [r for m in many for r in m]
    points = np.concatenate(flat)
    found = repair.mended(points[:, 0], points[:, 1], np.repeat(np.arange(len(flat)), [len(r) for r in flat]), np.repeat(np.arange(60), [len(m) for m in many]), 60)
    assert [[[list(map(list, r)) for r in p] for p in m] for m in found] == alone and len(calls) == 1 and sum(map(len, alone)) > 30
    assert same("repaired_zones", customer=keyed("customer", "c_custkey", "range(1, 151)")) > 100


def test_rows_of_small_tables_are_dealt_before_much_work(spark):
    from siteloom.plans import catalog

    for name in ("repaired_zones", "buffer_zones", "raster_windows"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_hulls_come_from_arrays_and_not_a_frame_for_each_key(spark, same):
    from siteloom.operators.shapes import hull_rings
    from siteloom.plans import catalog

    assert same("layout_screens", customer=keyed("customer", "c_custkey", "range(0, 150)")) == 19
    assert "Pandas" not in catalog.queries()["layout_screens"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    frame = spark.createDataFrame([(None, 0.0, 0.0), (None, 2.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 1.0), (None, 2.0, None), ("a", 1.0, 1.0), ("a", 1.0, 1.0)], "k string, x double, y double")
    assert {r["k"]: [tuple(p) for p in r["hull"]] for r in hull_rings(frame, "k", "x", "y").collect()} == {None: [(0.0, 0.0), (2.0, 0.0), (0.0, 1.0)], "a": [(1.0, 1.0)]}


def test_a_tile_is_made_and_read_some_features_at_a_time(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from siteloom.sources import vectortiles as v

    n = 30_000
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.int64())]))
    table = pa.table({"id": range(n), "layer": [("a", "b")[i % 2] for i in range(n)], "attrs": pa.array([[{"key": "kv", "value": i % 5}] for i in range(n)], kind), "geometry": pa.array([v.commands([np.array([[0, 0], [i % 90, 1]])]) for i in range(n)], pa.binary())})
    tracemalloc.start()
    data = v.tile_of(table, v.EXTENT)
    found = v.decoded(pa.scalar(data, pa.binary()), {b"b": "b"})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and len(found) > 1
    got = [r for batch in found for r in batch.to_pylist()]
    assert [r["id"] for r in got] == list(range(1, n, 2)) and all(r["attrs"] == [("kv", r["id"] % 5)] and r["lines"] == [[{"x": 0, "y": 0}, {"x": r["id"] % 90, "y": 1}]] for r in got)
    assert v.decoded(pa.scalar(data + b"\x1a", pa.binary()), {b"b": "b"}) == [] and v.decoded(pa.scalar(None, pa.binary()), {b"b": "b"}) == []


def test_a_block_of_queries_is_scored_some_at_a_time():
    import tracemalloc

    from siteloom.operators.vectors import best_of

    rng = np.random.default_rng(6)
    v = rng.standard_normal((4000, 16))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    ids = np.arange(4000)
    tracemalloc.start()
    found = list(best_of(ids[:1000], v[:1000], ids, v, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and len(found) == 1000
    for name, best, score in found[::200]:
        want = np.floor(v @ v[name[0]] * 1e9 + 0.5) / 1e9
        want[name[0]] = -np.inf
        assert best.tolist() == np.argsort(-want, kind="stable")[:10].tolist() and len(score) == 10
