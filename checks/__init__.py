"""Queries that run every operator over the driver tables, with the SQL their results are compared with."""

from checks.base import ORACLE, QUERIES
from checks import column_checks, extract_checks, join_checks, normalize_checks, ranking_checks, render_checks  # noqa: F401

__all__ = ["QUERIES", "ORACLE"]
