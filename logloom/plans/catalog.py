"""All registered queries."""

from . import incident_queries, registry, rule_queries, scalar_queries, search_queries, stored_queries  # noqa: F401
from .registry import ORACLES, QUERIES, run

__all__ = ["ORACLES", "QUERIES", "registry", "run"]
