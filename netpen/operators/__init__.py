"""Reusable DataFrame operators: skew-safe scans and joins, latest rows, range joins, listings."""
