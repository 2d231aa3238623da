"""Compositions of operators: whole audits, comparisons and repository context."""
