"""Queries against their SQL on small tables that hold the cases of the third round's findings."""

import duckdb
import pytest

from siteloom.plans import catalog
from tests.test_queries import DATA, pytestmark, rows  # noqa: F401


@pytest.fixture
def same(spark, tmp_path):
    """Compares a query with its SQL; tables are given as SQL, the others are the smallest ones."""

    def compare(name: str, **tables: str) -> int:
        con = duckdb.connect()
        for t in ("nation", "supplier", "customer", "part", "orders", "lineitem", "events", "embeddings"):
            con.execute(f"COPY ({tables.get(t, f"SELECT * FROM '{DATA}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = rows(catalog.queries()[name](spark, str(tmp_path)).toPandas())
        assert got == rows(con.execute(catalog.oracle_sql()[name]).df())
        return len(got)

    return compare


def keyed(table: str, key: str, keys: str) -> str:
    """The table's first rows under the given keys, an SQL list or range."""
    return f"SELECT * REPLACE (k AS {key}) FROM (SELECT k, row_number() OVER () AS n FROM (SELECT CAST(unnest({keys}) AS BIGINT) AS k)) JOIN (SELECT *, row_number() OVER () AS n FROM '{DATA}/{table}.parquet') t USING (n)".replace("SELECT *", "SELECT * EXCLUDE (k, n)", 1)


ON_BORDERS = keyed("part", "p_partkey", "[6700, 14400, 18360, 100, 200, 300, 400, 2000, 11100]")


def test_turbines_on_an_areas_border(same):
    assert same("turbines_in_aoi", part=f"SELECT * EXCLUDE (k) REPLACE (k AS p_partkey) FROM (SELECT p.*, r.k FROM '{DATA}/part.parquet' p, range(0, 20000, 200) r(k) WHERE p_partkey <= 1) UNION ALL {ON_BORDERS}") > 5


def test_sites_on_an_areas_border(same):
    same("point_exclusion_hits", supplier=keyed("supplier", "s_suppkey", "[800, 382, 1, 2]"))


def test_pixels_on_an_areas_border(same):
    same("exclusion_coverage", part=ON_BORDERS)


def test_districts_of_turbines_on_a_border(same):
    assert same("turbine_districts", part=ON_BORDERS) == 9


def test_shear_takes_every_line(spark):
    """A site with key 3 modulo 8 has lines at all three heights, and all are fitted."""
    found = catalog.queries()["shear_fit_by_site"](spark, DATA).where("site % 8 = 3").collect()
    assert found and all(r["heights"] == 3 for r in found)
    assert "l_suppkey % 8" not in catalog.oracle_sql()["shear_fit_by_site"]


MANY_MASTS = f"SELECT * REPLACE (k AS c_custkey) FROM (SELECT c.*, r.k FROM '{DATA}/customer.parquet' c, range(1, 15001) r(k) WHERE c_custkey = (SELECT min(c_custkey) FROM '{DATA}/customer.parquet'))".replace("SELECT *", "SELECT * EXCLUDE (k)", 1)


def test_zones_that_touch_an_area(same):
    same("exclusion_overlap", supplier=keyed("supplier", "s_suppkey", "[382, 7, 11]"), customer=MANY_MASTS)


def test_a_ring_is_built_once_in_clipping(spark):
    from pyspark.sql import functions as F

    from siteloom.operators.shapes import clipped

    ring = F.array(*[F.struct((F.col("id") + float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))])
    plan = spark.range(1).select(clipped(ring, ring).alias("cut"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_struct(x") < 40


def test_masts_in_reach_are_told_in_few_rows(spark, same):
    """Sites' cells are told within one step over arrays, not by a row and formulas for every cell."""
    from pyspark.sql import functions as F

    from siteloom.operators.proximity import counts_within

    assert same("masts_within_radius", supplier=keyed("supplier", "s_suppkey", "range(1, 11)"), customer=MANY_MASTS) == 10
    points = spark.range(50).select((F.col("id") / 10.0 + 70).alias("plon"), F.lit(20.0).alias("plat"))
    plan = counts_within(spark.createDataFrame([(1, 70.0, 20.0)], "site long, lon double, lat double"), points, [100.0, 20.0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert "strategy=merge" in plan and "strategy=shuffle_hash" in plan


def test_rings_of_masts_without_pairs(spark, same, tmp_path):
    assert same("ring_search", supplier=keyed("supplier", "s_suppkey", "range(1, 11)"), customer=MANY_MASTS) == 10
    plan = catalog.queries()["ring_search"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 0


def test_the_nearest_usable_mast_is_sought_in_widening_cells(spark, same, tmp_path):
    same("mast_validation", supplier=keyed("supplier", "s_suppkey", "range(1, 11)"), customer=MANY_MASTS)
    plan = catalog.queries()["mast_validation"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_regridded_points_come_from_squares(spark, same):
    assert same("regrid", part=keyed("part", "p_partkey", "range(1, 400, 3)")) > 1
    plan = catalog.queries()["regrid"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "explode([-3" not in plan


def test_clicks_open_only_cells_with_an_earlier_mark(spark, same):
    assert same("snap_points", supplier=keyed("supplier", "s_suppkey", "range(1, 11)"), customer=MANY_MASTS) == 10
    plan = catalog.queries()["snap_points"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and "strategy=merge" in plan


def test_a_cube_counts_parts_without_rows_for_each_set(spark, same):
    same("line_cube", lineitem=f"SELECT * FROM '{DATA}/lineitem.parquet' UNION ALL (SELECT * REPLACE (CAST(NULL AS BIGINT) AS l_partkey, CAST(NULL AS VARCHAR) AS l_returnflag) FROM '{DATA}/lineitem.parquet' LIMIT 50)")
    plan = catalog.queries()["line_cube"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan


def test_zones_are_cut_once_for_all_areas(spark, same):
    assert same("exclusion_union", supplier=keyed("supplier", "s_suppkey", "range(1, 4)"), customer=MANY_MASTS.replace("range(1, 15001)", "range(1, 601)")) >= 0
    plan = catalog.queries()["exclusion_union"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan


def test_pieces_that_fill_their_cell_are_told():
    import numpy as np

    from siteloom.operators.coverage import _half, _pieces, fills, half

    ring = [(0.15, 0.1), (0.95, 0.2), (0.5, 0.5), (0.9, 0.9), (0.1, 0.8)]
    for axis, bound, above in ((0, 0.4, True), (1, 0.6, False), (0, 2.0, True), (1, 0.0, True)):
        got, want = _half(ring, axis, bound, above), half(np.array(ring), axis, bound, above)
        turned = sorted(got)
        assert np.allclose(turned, sorted(map(tuple, want.tolist()))) if got else not len(want)
    told = {(cx, cy): fills(piece, cx, cy, 0.1) for cx, cy, piece in _pieces(ring, 0.1, _half)}
    assert told[3, 4] is True and told[1, 1] is False and told.get((7, 5)) is not True
