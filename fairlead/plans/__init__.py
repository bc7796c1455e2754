"""Bindings of the driver tables onto the operators, and their check SQL."""

from fairlead.plans import path_queries, source_queries, store_queries, text_queries, track_queries, trip_queries  # noqa: F401
from fairlead.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
