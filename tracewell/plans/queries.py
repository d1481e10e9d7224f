"""The registered queries over the star-schema tables, with their SQL."""

from tracewell.plans import dumps, graphs, privacy, replication, streams  # noqa: F401
from tracewell.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
