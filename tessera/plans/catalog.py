"""All registered queries."""

from tessera.plans import graph_queries, relational_queries, request_queries, rule_queries, scoring_queries, source_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
