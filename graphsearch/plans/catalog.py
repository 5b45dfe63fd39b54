"""All queries of the library."""

from __future__ import annotations

from graphsearch.plans import corpus, graphs, more, search  # noqa: F401  they register their queries
from graphsearch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
