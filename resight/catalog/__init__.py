"""Runnable queries over the given tables, each with its SQL counterpart where one exists."""

from resight.catalog import counts, likelihood, model, report, sheets  # noqa: F401
from resight.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
