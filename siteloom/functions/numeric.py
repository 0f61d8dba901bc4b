"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round with halves towards plus infinity, at ``digits`` decimals."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Straight lines through the knots, held at both ends; null or NaN gives null."""
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + F.lit(y1 - y0) * ((x - F.lit(x0)) / F.lit(x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def sql_piecewise(x: str, knots: list[tuple[float, float]]) -> str:
    """The same as SQL text."""
    parts = [f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} <= {knots[0][0]} THEN {knots[0][1]}::DOUBLE"]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        parts.append(f"WHEN {x} <= {x1} THEN {y0}::DOUBLE + {y1 - y0!r}::DOUBLE * (({x} - {x0}::DOUBLE) / {x1 - x0!r}::DOUBLE)")
    return " ".join(parts) + f" ELSE {knots[-1][1]}::DOUBLE END"
