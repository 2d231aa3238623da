"""Public surface: DataFrames in, DataFrames out."""

from gatewright.operators.fixplan import fix_plan_candidates, fix_plans
from gatewright.operators.jobs import audit_history as history
from gatewright.operators.presence import free_check
from gatewright.plans.audit import Audit, audit, corpus_of, fixables, quality_status, report_sections, reports
from gatewright.plans.compare import compare, release_check
from gatewright.plans.context import dependency_graph, repo_context, repo_map, symbol_map


def fix_plan(result: Audit, languages=None):
    """Prioritised plans for the worst findings of every repository."""
    return fix_plans(fix_plan_candidates(fixables(result)), languages)


__all__ = [
    "Audit", "audit", "compare", "corpus_of", "dependency_graph", "fix_plan", "free_check", "history",
    "quality_status", "release_check", "repo_context", "repo_map", "report_sections", "reports", "symbol_map",
]
