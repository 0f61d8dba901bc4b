"""All base queries and their SQL, by name."""

from __future__ import annotations

from siteloom.plans import analysis, climate, fields, finance, grids, labels, policy, records, reports, retrieval, shapes, spatial, text, tiles, wind, zones

FAMILIES = (wind, spatial, climate, policy, finance, text, retrieval, shapes, labels, records, fields, reports, zones, grids, tiles, analysis)


def queries() -> dict:
    return {k: v for family in FAMILIES for k, v in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for family in FAMILIES for k, v in family.SQL.items()}
