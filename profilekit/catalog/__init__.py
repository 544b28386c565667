"""Queries over the shared test tables, each with the SQL that must give the same rows."""

from profilekit.catalog import cluster_queries, label_queries, profile_queries, search_queries, shape_queries, text_queries  # noqa: F401
from profilekit.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
