"""Wind resource, energy and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.numeric import clamp, half_up, piecewise

# Mean wind speed (m/s) to capacity factor.
CUF_CURVE = [(4.0, 0.25), (4.5, 0.3), (5.0, 0.34), (5.5, 0.38), (6.0, 0.4), (6.5, 0.42), (7.0, 0.43), (8.0, 0.45), (9.0, 0.46)]
# Capacity factor to resource score.
RESOURCE_ANCHORS = [(0.28, 0.12), (0.34, 0.42), (0.38, 0.62), (0.4, 0.76), (0.42, 0.86), (0.44, 0.94), (0.46, 1.0)]
# Km at which a line or substation counts fully and not at all, their weights, and the score of a missing one.
LINE_KM, SUB_KM = (2.0, 40.0), (5.0, 80.0)
LINE_SHARE, SUB_SHARE, MISSING = 0.6, 0.4, 0.15
RESOURCE_POINTS, GRID_POINTS = 72.0, 28.0
RATINGS = [(75, "Excellent"), (60, "Good"), (45, "Moderate"), (30, "Marginal")]
# Wind speed (m/s) to share of rated power, by turbine class.
POWER_CURVES = {
    "iec1": [(3, 0.02), (4, 0.05), (5, 0.11), (6, 0.19), (7, 0.31), (8, 0.45), (9, 0.6), (10, 0.74), (11, 0.85), (12, 0.93), (13, 0.98), (14, 1.0), (25, 1.0)],
    "iec2": [(3, 0.03), (4, 0.08), (5, 0.16), (6, 0.27), (7, 0.42), (8, 0.59), (9, 0.75), (10, 0.88), (11, 0.96), (12, 0.99), (13, 1.0), (25, 1.0)],
    "iec3": [(3, 0.04), (4, 0.1), (5, 0.2), (6, 0.34), (7, 0.52), (8, 0.7), (9, 0.85), (10, 0.95), (11, 0.99), (12, 1.0), (25, 1.0)],
}
CUT_IN, CUT_OUT, SPEED_STEP, SPEED_MAX = 3.0, 25.0, 0.25, 30.0
SEA_LEVEL_DENSITY = 1.225
# Losses and one-sigma uncertainties.
LOSSES = {"availability": 0.04, "electrical": 0.025, "soiling": 0.02, "curtailment": 0.02}
SIGMAS = {"interannual": 0.06, "model": 0.06, "curve": 0.03, "loss": 0.05}
Z75, Z90 = 0.674, 1.282


def cuf(speed: Column) -> Column:
    return piecewise(speed, CUF_CURVE)


def resource_score(factor: Column) -> Column:
    return piecewise(factor, RESOURCE_ANCHORS)


def _nearness(km: Column, full: float, none: float) -> Column:
    return F.when(km.isNull() | F.isnan(km), F.lit(MISSING)).otherwise(clamp(F.lit(1.0) - (km - F.lit(full)) / F.lit(none - full), 0, 1))


def grid_score(line_km: Column, sub_km: Column) -> Column:
    return F.lit(LINE_SHARE) * _nearness(line_km, *LINE_KM) + F.lit(SUB_SHARE) * _nearness(sub_km, *SUB_KM)


def site_score(resource: Column, grid: Column) -> Column:
    return half_up(F.lit(RESOURCE_POINTS) * resource + F.lit(GRID_POINTS) * grid).cast("int")


def rating(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in RATINGS:
        out = out.when(score >= least, name)
    return out.otherwise("Poor")


def air_density(metres: Column) -> Column:
    return F.lit(SEA_LEVEL_DENSITY) * F.pow(F.lit(1.0) - F.lit(2.2558e-5) * metres, F.lit(5.256))


def weibull_pdf(v: Column, scale: Column, shape: Column) -> Column:
    ratio = v / scale
    return shape / scale * F.pow(ratio, shape - 1) * F.exp(-F.pow(ratio, shape))


def power_share(v: Column, curve: list[tuple[float, float]]) -> Column:
    return F.when((v < CUT_IN) | (v > CUT_OUT), F.lit(0.0)).otherwise(piecewise(v, [(float(a), float(b)) for a, b in curve]))


def wake_loss(mw_per_km2: float) -> float:
    return min(0.25, max(0.03, 0.02 + 0.016 * mw_per_km2))


def net_share(mw_per_km2: float = 5.0) -> float:
    out = 1 - wake_loss(mw_per_km2)
    for loss in LOSSES.values():
        out *= 1 - loss
    return out


def sigma() -> float:
    return sum(s * s for s in SIGMAS.values()) ** 0.5
