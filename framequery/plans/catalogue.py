"""Queries over the driver tables, each with its oracle."""

from framequery.plans import basics, joins, more, windows  # noqa: F401  (they register their queries)
from framequery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
