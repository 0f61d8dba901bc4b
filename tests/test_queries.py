"""Every base query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from siteloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, bool) or str(x) in ("True", "False"):
            return str(bool(x))
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        try:
            return repr(round(float(x), 6) + 0.0)
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_monte_carlo_band_agrees_with_plain_python(spark):
    from siteloom.functions import finance, wind
    from siteloom.functions.finance import equity_flows_of, irr_of
    from siteloom.plans.finance import monte_carlo_band

    band = monte_carlo_band(spark, DATA).orderBy("speed").first()
    state, u = 42, []
    for _ in range(4000 * 8):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        u.append((t ^ t >> 14) / 2**32)
    import numpy as np

    u = np.array(u).reshape(4000, 8)
    drawn = {}
    for i, (name, (a, m, b)) in enumerate(finance.DRAWS.items()):
        c = (m - a) / (b - a)
        drawn[name] = np.where(u[:, i] < c, a + np.sqrt(u[:, i] * (b - a) * (m - a)), b - np.sqrt((1 - u[:, i]) * (b - a) * (b - m)))
    cuf = np.interp(band["speed"], *zip(*wind.CUF_CURVE, strict=True))
    found = irr_of(equity_flows_of(cuf * drawn["cuf_scale"] * finance.HOURS, drawn["ppa"] + drawn["rec"] + drawn["tod"] + drawn["carbon"], drawn["capex"], drawn["om"], drawn["interest"]))
    assert band["n"] == 4000
    for name, q in (("p10", 10), ("p50", 50), ("p90", 90)):
        assert abs(band[name] - np.percentile(found, q)) < 2e-6


def test_tornado_ranks_by_influence(spark):
    from siteloom.plans.finance import sensitivity_tornado

    found = sensitivity_tornado(spark, DATA).toPandas()
    assert len(found) == 8 * found["site"].nunique()
    for _, own in found.groupby("site"):
        size = own.sort_values("rank")[["low", "high"]].abs().max(axis=1)
        assert (size.diff().dropna() <= 1e-9).all()


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
