"""Loads every query module; importing it fills the registry."""

from . import (  # noqa: F401
    queries_claims,
    queries_fill,
    queries_grid,
    queries_income,
    queries_quality,
    queries_report,
    queries_rollup,
    queries_series,
    queries_sheets,
    queries_sources,
    queries_tables,
    queries_text,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
