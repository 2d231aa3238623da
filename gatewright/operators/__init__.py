"""Audit operators: each maps DataFrames to DataFrames keyed by ``repo_id``."""
