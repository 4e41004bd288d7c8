"""All registered queries."""

from panelyard.plans import queries_models, queries_prep, queries_scenarios, queries_sources, queries_study  # noqa: F401
from panelyard.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
