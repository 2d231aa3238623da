"""Structured Streaming forms of the audit-history operators."""
