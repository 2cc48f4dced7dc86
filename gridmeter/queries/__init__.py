"""Registered queries with their SQL counterparts."""

from gridmeter.queries import (  # noqa: F401
    aggregates, bills, forecasting, grid, joins, quality, scalars, sources, windows,
)
from gridmeter.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
