"""Exact positions and running sums over a whole table: the base engine's."""

from siteloom.operators.positions import ranked

__all__ = ["ranked"]
