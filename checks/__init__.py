"""Queries over the given tables, each with the SQL that must give the same rows."""

from checks.registry import ORACLES, QUERIES
from checks import job_queries, manifest_queries, metric_queries, signal_queries  # noqa: F401
