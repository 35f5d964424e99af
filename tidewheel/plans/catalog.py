"""All named queries over the star schema and the event table, with their oracle SQL."""

from __future__ import annotations

from . import event_queries, function_queries, relational_queries, source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
