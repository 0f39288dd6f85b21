"""Named queries and the SQL that gives the same rows."""

from quire.plans import documents, queues, runs, sinks, texts, urls  # noqa: F401
from quire.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
