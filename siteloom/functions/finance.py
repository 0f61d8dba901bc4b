"""Project finance: cash flows as arrays, net present value, internal rate of return, draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the wind project model, per MW; money in crore (1e7) or rupees a kWh.
CAPEX_CR = 9.0
PPA = 3.5
OM_CR = 0.13
OM_GROWTH = 1.05
LIFE = 20
REC = 0.35
TOD = 0.4
CARBON = 0.25
DEBT_SHARE = 0.75
TENURE = 15
INTEREST = 0.095
DEPRECIATION = 0.0467
DEPRECIATION_YEARS = 15
DEPRECIATION_CAP = 0.9
TAX = 0.1747
HOURS = 8766.0
DISCOUNT = 0.1
IRR_LOW, IRR_HIGH = -0.95, 3.0

# Fixed values: (least, most likely, most) of what the Monte Carlo model draws, in the order it draws them.
DRAWS = {
    "ppa": (3.3, 3.5, 3.7),
    "rec": (0.25, 0.35, 0.45),
    "tod": (0.3, 0.4, 0.52),
    "carbon": (0.15, 0.25, 0.32),
    "om": (0.12, 0.13, 0.15),
    "cuf_scale": (0.92, 1.0, 1.08),
    "interest": (0.085, 0.095, 0.105),
    "capex": (8.5, 9.0, 9.5),
}


def equity_flows(mwh: Column, tariff: Column, capex_cr: Column, om_cr: Column, interest: Column) -> Column:
    """Equity cash flow of years 0 to LIFE, in rupees."""
    capex = capex_cr * F.lit(1e7)
    debt = capex * F.lit(DEBT_SHARE)

    def year(y: Column) -> Column:
        income = mwh * F.lit(1000.0) * tariff
        upkeep = om_cr * F.lit(1e7) * F.pow(F.lit(OM_GROWTH), y - 1)
        paying = y <= TENURE
        due = F.when(paying, debt * (F.lit(1.0) - (y - 1) / F.lit(float(TENURE))) * interest).otherwise(0.0)
        back = F.when(paying, debt / F.lit(float(TENURE))).otherwise(0.0)
        written = _written_off(capex, y)
        gain = income - upkeep - due - written
        tax = F.when(gain > 0, gain * F.lit(TAX)).otherwise(0.0)
        return income - upkeep - due - back - tax

    return F.concat(F.array(-(capex - debt)), F.transform(F.sequence(F.lit(1), F.lit(LIFE)), year))


def project_flows(mwh: Column, tariff: Column, capex_cr: Column, om_cr: Column) -> Column:
    """Cash flow of the project without its loan, years 0 to LIFE, in rupees."""
    capex = capex_cr * F.lit(1e7)

    def year(y: Column) -> Column:
        income = mwh * F.lit(1000.0) * tariff
        upkeep = om_cr * F.lit(1e7) * F.pow(F.lit(OM_GROWTH), y - 1)
        gain = income - upkeep - _written_off(capex, y)
        return income - upkeep - F.when(gain > 0, gain * F.lit(TAX)).otherwise(0.0)

    return F.concat(F.array(-capex), F.transform(F.sequence(F.lit(1), F.lit(LIFE)), year))


def _written_off(capex: Column, y: Column) -> Column:
    left = capex * F.lit(DEPRECIATION_CAP) - capex * F.lit(DEPRECIATION) * (y - 1)
    return F.when(y <= DEPRECIATION_YEARS, F.greatest(F.lit(0.0), F.least(capex * F.lit(DEPRECIATION), left))).otherwise(0.0)


def npv(rate: Column | float, flows: Column) -> Column:
    """Sum of flows discounted from year 0."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return F.aggregate(F.transform(flows, lambda c, t: c / F.pow(F.lit(1.0) + rate, t.cast("double"))), F.lit(0.0), lambda a, x: a + x)


def first_year_paid(flows: Column) -> Column:
    """The first year from 1 on in which the running sum is not negative."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("year"), F.lit(None).cast("int").alias("paid"))

    def step(s: Column, c: Column) -> Column:
        total, year = s["sum"] + c, s["year"] + 1
        return F.struct(total.alias("sum"), year.alias("year"), F.when(s["paid"].isNull() & (year >= 1) & (total >= 0), year).otherwise(s["paid"]).alias("paid"))

    return F.aggregate(flows, start, step)["paid"]


def payback(flows: Column) -> Column:
    """The point, in years, at which the running sum stops being negative, between two years by the share of the later flow; LIFE if it never does."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("year"), F.lit(None).cast("double").alias("paid"))

    def step(s: Column, c: Column) -> Column:
        total, year = s["sum"] + c, s["year"] + 1
        crossed = s["paid"].isNull() & (total >= 0) & (s["sum"] < 0)
        return F.struct(total.alias("sum"), year.alias("year"), F.when(crossed, year - s["sum"] / c).otherwise(s["paid"]).alias("paid"))

    return F.coalesce(F.aggregate(flows, start, step)["paid"], F.lit(float(LIFE)))


def irr_of(flows: np.ndarray, steps: int = 120, halvings: int = 4) -> np.ndarray:
    """The rate at which each row's value is nothing; NaN where both ends have one sign.

    A few halvings, then Newton's steps as long as they stay within the
    bracket, which every step narrows; rows that no longer move are done.
    """
    years = flows.shape[1]

    def value(own: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row's value at a rate, and its slope."""
        x = 1 / (1 + rate)
        out, slope = np.zeros(len(rate)), np.zeros(len(rate))
        for t in range(years - 1, -1, -1):
            slope = slope * x + out
            out = out * x + own[:, t]
        return out, -slope * x * x

    low, high = np.full(len(flows), IRR_LOW), np.full(len(flows), IRR_HIGH)
    at_low = value(flows, low)[0]
    with np.errstate(invalid="ignore"):
        none = ~(at_low * value(flows, high)[0] <= 0)
    found = np.where(none, np.nan, (low + high) / 2)
    left = np.flatnonzero(~none)
    own, low, high, at_low, rate = flows[left], low[left], high[left], at_low[left], found[left]
    for k in range(steps):
        if not len(left):
            break
        here, slope = value(own, rate)
        below = at_low * here < 0
        high = np.where(below, rate, high)
        at_low = np.where(below, at_low, here)
        low = np.where(below, low, rate)
        with np.errstate(divide="ignore", invalid="ignore"):
            newton = rate - here / slope
        inside = (newton >= low) & (newton <= high) if k >= halvings else np.zeros(len(left), bool)
        after = np.where(inside, newton, (low + high) / 2)
        done = (np.abs(after - rate) < 1e-14) | (high - low < 1e-13)
        found[left] = after
        keep = ~done
        left, own, low, high, at_low, rate = left[keep], own[keep], low[keep], high[keep], at_low[keep], after[keep]
    return found


@F.pandas_udf(T.DoubleType())
def irr(flows: pd.Series) -> pd.Series:
    """Internal rate of return of arrays of equal length; null where there is none."""
    if not len(flows):
        return pd.Series([], dtype="float64")
    return pd.Series(irr_of(np.stack(flows.to_numpy()).astype(float))).replace({np.nan: None}).astype("float64")


def equity_flows_of(mwh: np.ndarray, tariff: np.ndarray, capex_cr: np.ndarray, om_cr: np.ndarray, interest: np.ndarray) -> np.ndarray:
    """``equity_flows`` for arrays: a row of LIFE + 1 flows for each entry."""
    capex = capex_cr * 1e7
    debt = capex * DEBT_SHARE
    out = np.empty((len(mwh), LIFE + 1))
    out[:, 0] = debt - capex
    for y in range(1, LIFE + 1):
        earned = mwh * 1000 * tariff - om_cr * 1e7 * OM_GROWTH ** (y - 1)
        due = debt * (1 - (y - 1) / TENURE) * interest if y <= TENURE else 0.0
        off = np.maximum(0, np.minimum(capex * DEPRECIATION, capex * DEPRECIATION_CAP - capex * DEPRECIATION * (y - 1))) if y <= DEPRECIATION_YEARS else 0.0
        out[:, y] = earned - due - (debt / TENURE if y <= TENURE else 0.0) - np.maximum(0, earned - due - off) * TAX
    return out


@F.pandas_udf(T.DoubleType())
def equity_irr(mwh: pd.Series, tariff: pd.Series, capex_cr: pd.Series, om_cr: pd.Series, interest: pd.Series) -> pd.Series:
    """The equity's return straight from the inputs: for many draws, where arrays of flows would be the cost."""
    found = irr_of(equity_flows_of(*(x.to_numpy(dtype=float) for x in (mwh, tariff, capex_cr, om_cr, interest))))
    return pd.Series(found).replace({np.nan: None}).astype("float64")


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two numbers below 2**32, without overflow of 64 bits."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(0xFFFFFFFF))


def uniform(index: Column, seed: int = 42) -> Column:
    """The ``index``-th number (from 0) of the mulberry32 sequence, without the ones before it."""
    word = F.lit(0xFFFFFFFF)
    a = (F.lit(seed).cast("long") + _mul32((index.cast("long") + 1).bitwiseAND(word), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(word)
    t = _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = ((t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(word)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    """The value whose cumulated share under a triangular distribution is ``u``."""
    cut = (mode - low) / (high - low)
    rise = F.lit(low) + F.sqrt(u * F.lit((high - low) * (mode - low)))
    fall = F.lit(high) - F.sqrt((F.lit(1.0) - u) * F.lit((high - low) * (high - mode)))
    return F.when(u < cut, rise).otherwise(fall)
