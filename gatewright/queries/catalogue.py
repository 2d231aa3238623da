"""All registered queries."""

from gatewright.queries import content, context, feeds, gates, mapping, scans  # noqa: F401
from gatewright.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
