"""Two audits of the same repositories side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gatewright.operators import diff, gate
from gatewright.plans.audit import Audit, fixables


def compare(base: Audit, head: Audit, epsilon: float = 0.0) -> dict[str, DataFrame]:
    """Score deltas, rule attribution, finding status, moves and the gate comparison, all repositories at once."""
    status = diff.finding_status(fixables(base), fixables(head))
    return {
        "scores": diff.score_deltas(base.scores, head.scores, epsilon),
        "rules": diff.rule_deltas(base.score_rules, head.score_rules),
        "findings": status,
        "moved": diff.moved_findings(status),
        "gate": gate.compare_gates(
            base.verdict,
            head.verdict,
            gate.blocking_keys(base.checks, base.gate_findings),
            gate.blocking_keys(head.checks, head.gate_findings),
        ),
    }


def release_check(result: Audit) -> DataFrame:
    """Ship or block per repository, with the failing checks."""
    from pyspark.sql import functions as F

    failing = (
        result.checks.where(F.col("status") == "fail")
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list("check_id")).alias("failing"))
    )
    return result.verdict.select("repo_id", "ship", "status").join(failing, "repo_id", "left")
