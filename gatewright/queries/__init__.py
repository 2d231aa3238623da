"""Registered queries: each operator over the driver tables, with reference SQL where SQL can say it."""
