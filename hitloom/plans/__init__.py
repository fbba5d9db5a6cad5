"""Registered queries, by subject."""

from hitloom.plans import clusters, joins, positions, results, scans, tracking  # noqa: F401
