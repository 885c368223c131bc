"""Queries over the given tables, with their DuckDB counterparts."""
