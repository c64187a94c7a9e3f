"""All named queries and their SQL."""

from tillworks.registry import gold, governance, lookup, search, streams, vectors  # noqa: F401
from tillworks.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
