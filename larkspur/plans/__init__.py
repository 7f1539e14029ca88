"""Registered queries with their SQL, and the pipeline from raw lines to named segments."""

from . import evidence_queries, queries  # noqa: F401 - both register their queries
