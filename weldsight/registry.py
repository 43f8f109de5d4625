"""Registered queries and their SQL."""

from weldsight.plans import summary_queries  # noqa: F401  adds its own
from weldsight.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
