"""The findings model: drafts, rule mapping, keys, grouping and blockers.

A findings table has one row per finding:
    repo_id, section, ord, id, category, severity, title, evidence, action, criteria
and, once enriched, rule_id, confidence, verification, fingerprint.
``section`` is the analyzer list it came from and ``ord`` its place in it;
ordering always ends in ``id`` so that ties are settled the same way everywhere.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.functions import text as X
from gatewright.operators.scale import top_k

EVIDENCE = "array<struct<file:string,line:int,reason:string,source:string>>"
# First ord of each analyzer inside the security list.
SECURITY_ORD = {"secret": 0, "injection": 10**18, "history": 2 * 10**18, "hygiene": 3 * 10**18}
DRAFT_COLUMNS = [
    "repo_id", "section", "ord", "id", "category", "severity", "title", "evidence", "action", "criteria",
]


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def evidence(file, line=None, reason="", source=None) -> Column:
    return F.struct(
        _col(file).cast("string").alias("file"),
        _col(line).cast("int").alias("line"),
        _col(reason).cast("string").alias("reason"),
        _col(source).cast("string").alias("source"),
    )


def draft(section, ord_, id_, category, severity, title, proof: Column, action=None, criteria=None) -> Column:
    """One finding as a struct; arguments are values or columns."""
    title = _col(title)
    action = F.concat(F.lit("Address: "), title) if action is None else _col(action)
    if criteria is None:
        criteria = F.array(F.concat(F.lit("Not reported any more: "), _col(id_)))
    elif not isinstance(criteria, Column):
        criteria = F.array(*[_col(c) for c in criteria])
    return F.struct(
        _col(section).alias("section"),
        _col(ord_).cast("bigint").alias("ord"),
        _col(id_).alias("id"),
        _col(category).alias("category"),
        _col(severity).alias("severity"),
        title.alias("title"),
        proof.cast(EVIDENCE).alias("evidence"),
        action.alias("action"),
        criteria.cast("array<string>").alias("criteria"),
    )


def explode_drafts(rows: DataFrame, drafts: list[tuple[Column, Column]]) -> DataFrame:
    """One pass over ``rows``: every (condition, draft) pair that fires becomes a finding."""
    fired = F.array_compact(F.array(*[F.when(cond, d) for cond, d in drafts]))
    return rows.select("repo_id", F.explode(fired).alias("f")).select("repo_id", "f.*")


# --- severity -------------------------------------------------------------------
def severity_rank(severity: Column) -> Column:
    """0 critical .. 3 low."""
    return (
        F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)
    )


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in D.SEVERITIES]), rank + 1)


# --- rules and keys ---------------------------------------------------------------
VERIFICATION = "struct<kind:string,target:string,expected:string,note:string>"


_RULE = f"struct<rule_id:string,source:string,confidence:double,verification:{VERIFICATION}>"


def _rule_row(row: tuple) -> dict:
    rule_id, source, confidence, kind, target, note = row
    check = {"kind": kind, "target": target, "expected": None, "note": note} if kind else None
    return {"rule_id": rule_id, "source": source, "confidence": confidence, "verification": check}


# One JSON literal each: the optimizer folds it to a constant, and plans stay small.
_EXACT = json.dumps({k: _rule_row(v) for k, v in D.EXACT_RULES.items()})
_PREFIXES = json.dumps({k: _rule_row(v) for k, v in D.PREFIX_RULES.items()})
# The longest prefix stands first, so it is the one that matches.
_PREFIX = r"\A(?:" + "|".join(re.escape(k) for k in sorted(D.PREFIX_RULES, key=lambda k: -len(k))) + ")"


def rule_of(finding_id: Column) -> Column:
    """Exact id, else the longest matching prefix, else UNMAPPED-<ID>.

    The registry is a few dozen fixed rows, so it is an expression, not a join:
    mapping never shuffles findings.
    """
    exact = F.element_at(F.from_json(F.lit(_EXACT), f"map<string,{_RULE}>"), finding_id)
    prefixes = F.from_json(F.lit(_PREFIXES), f"map<string,{_RULE}>")
    longest = F.element_at(prefixes, F.regexp_extract(finding_id, _PREFIX, 0))
    unmapped = F.struct(
        F.concat(F.lit("UNMAPPED-"), F.regexp_replace(F.upper(finding_id), "[^A-Z0-9]+", "-")).alias("rule_id"),
        F.lit("file").alias("source"),
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast(VERIFICATION).alias("verification"),
    )
    return F.coalesce(exact, longest, unmapped)


def _places(rule_id: Column, proof: Column) -> Column:
    """``rule|sorted(file:line or -)``."""
    places = F.transform(
        proof, lambda e: F.concat_ws(":", e["file"], F.coalesce(e["line"].cast("string"), F.lit("-")))
    )
    return F.concat(rule_id, F.lit("|"), F.array_join(F.array_sort(places), ","))


def fingerprint(rule_id: Column, proof: Column) -> Column:
    """16 hex digits over ``rule|sorted(file:line or -)``."""
    return X.fnv1a64_pair(_places(rule_id, proof))


def finding_key(df: DataFrame) -> Column:
    """Stored fingerprint, else the derived one (rows written before fingerprints existed)."""
    rule = F.coalesce(F.col("rule_id"), rule_of(F.col("id"))["rule_id"])
    return F.coalesce(F.col("fingerprint"), fingerprint(rule, F.col("evidence")))


def map_rules(findings: DataFrame) -> DataFrame:
    return findings.withColumn("_rule", rule_of(F.col("id"))).select(
        *[c for c in findings.columns if c not in ("rule_id", "confidence", "verification")],
        F.col("_rule.rule_id").alias("rule_id"),
        F.col("_rule.source").alias("rule_source"),
        F.col("_rule.confidence").alias("confidence"),
        F.col("_rule.verification").alias("verification"),
    )


def enrich_findings(findings: DataFrame) -> DataFrame:
    """Fill rule, confidence, verification, evidence source and fingerprint."""
    mapped = map_rules(findings)
    filled = F.transform(
        "evidence",
        lambda e: F.struct(
            e["file"].alias("file"),
            e["line"].alias("line"),
            e["reason"].alias("reason"),
            F.coalesce(e["source"], F.col("rule_source")).alias("source"),
        ),
    )
    return (
        mapped.withColumn("evidence", filled)
        .withColumn("fingerprint", X.fnv1a64_pairs(_places(F.col("rule_id"), F.col("evidence"))))
        .drop("rule_source")
    )


def first_file(proof: Column | str = "evidence") -> Column:
    proof = F.col(proof) if isinstance(proof, str) else proof
    return F.coalesce(F.get(proof, F.lit(0))["file"], F.lit(""))


def first_line(proof: Column | str = "evidence") -> Column:
    proof = F.col(proof) if isinstance(proof, str) else proof
    return F.get(proof, F.lit(0))["line"]


# --- splitting and routing ---------------------------------------------------------
def split_fixtures(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings in real code, findings whose first evidence is a fixture path)."""
    inside = P.is_fixture(first_file())
    return findings.where(~inside), findings.where(inside)


# list name -> position in the blocker concatenation
BLOCKER_LISTS = ["documentation", "reproducibility_all", "security", "deployment", "web3", "hackathon"]


def route_findings(findings: DataFrame) -> DataFrame:
    """Adds ``bucket``; one row per bucket the finding belongs to.

    ``section`` values: doc, repro, web3, hack, security, hygiene, quality.
    ``reproducibility_all`` is the analyzer's own list (blockers read it);
    ``reproducibility`` is what remains for scoring after deployment took its share.
    """
    s, i = F.col("section"), F.col("id")
    deploys = ((s == "repro") & i.isin(*D.DEPLOYMENT_IDS)) | ((s == "web3") & i.startswith("web3-"))
    buckets = F.array_compact(
        F.array(
            F.when(s == "doc", F.lit("documentation")),
            F.when(s == "repro", F.lit("reproducibility_all")),
            F.when(((s == "repro") & ~deploys) | (s == "hygiene"), F.lit("reproducibility")),
            F.when(s == "security", F.lit("security")),
            F.when(deploys, F.lit("deployment")),
            F.when(s == "web3", F.lit("web3")),
            F.when(s == "hack", F.lit("hackathon")),
            F.when(s == "quality", F.lit("quality")),
        )
    )
    return findings.select("*", F.explode(buckets).alias("bucket"))


# --- grouping -----------------------------------------------------------------------
def group_findings(findings: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Per (repo, file, rule): count, worst severity, first title, distinct lines.

    Lines are made distinct first, so a group holding most of the rows is
    combined before each shuffle; the list has one entry per line of one file
    (``max_lines`` keeps the first of them).
    """
    keys = ["repo_id", "file", "rule_id"]
    rows = findings.select(
        "repo_id",
        first_file().alias("file"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        first_line().alias("line"),
        severity_rank(F.col("severity")).alias("rank"),
        "title",
        "ord",
        "id",
    )
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("rank").alias("rank"),
        F.min_by("title", F.struct("ord", "id")).alias("title"),
    )
    distinct = rows.where(F.col("line") > 0).select(*keys, "line").distinct()
    lines = (
        top_k(distinct, keys, [F.col("line")], max_lines)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )
    return groups.join(lines, keys, "left").select(
        *keys,
        "count",
        severity_name(F.col("rank")).alias("severity"),
        "title",
        F.coalesce("lines", F.array().cast("array<int>")).alias("lines"),
    )


def condense_evidence(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Per repo: all groups as text; with ``limit`` the first of them, then one line for the rest."""
    order = [severity_rank(F.col("severity")), F.collate("file", "UNICODE"), F.collate("rule_id", "UNICODE")]
    top = top_k(groups, ["repo_id"], [*order, F.col("file"), F.col("rule_id")], limit)
    text = F.concat(
        "title",
        F.when(F.col("count") > 1, F.concat(F.lit(" ×"), F.col("count"))).otherwise(F.lit("")),
        F.when(F.col("file") != "", F.concat(F.lit(" in "), F.col("file"))).otherwise(F.lit("")),
    )
    shown = top.groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]).alias("lines"),
        F.count(F.lit(1)).alias("shown"),
        F.sum("count").alias("shown_findings"),
    )
    totals = groups.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("count").alias("findings")
    )
    hidden = F.col("groups") - F.col("shown")
    more = F.concat(
        F.lit("+"), hidden, F.lit(" more rule/file group"), F.when(hidden == 1, F.lit("")).otherwise(F.lit("s")),
        F.lit(" ("), F.col("findings") - F.col("shown_findings"), F.lit(" findings)"),
    )
    return totals.join(shown, "repo_id").select(
        "repo_id",
        F.when(hidden > 0, F.concat(F.col("lines"), F.array(more))).otherwise(F.col("lines")).alias("lines"),
        "groups",
        "findings",
    )


# --- blockers and tasks -----------------------------------------------------------------
def collect_blockers(routed: DataFrame, limit: int | None = None) -> DataFrame:
    """Critical and high findings of six lists in order, duplicates kept, ranked."""
    position = F.array_position(F.array(*[F.lit(b) for b in BLOCKER_LISTS]), F.col("bucket"))
    severe = routed.where(F.col("severity").isin("critical", "high")).withColumn("list_ord", position)
    severe = severe.where(F.col("list_ord") > 0)
    order = [severity_rank(F.col("severity")), F.col("list_ord"), F.col("ord"), F.col("id")]
    return top_k(severe, ["repo_id"], order, limit, rank="blocker_ord").drop("list_ord")


def recommended_tasks(blockers: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """A task for every blocker (with ``limit`` for the first ones), then those that the facts ask for."""
    sev = F.col("severity")
    columns = ["repo_id", "task_ord", "task_id", "title", "effort", "related", "criteria"]
    shown = blockers if limit is None else blockers.where(F.col("blocker_ord") <= limit)
    from_blockers = shown.select(
        "repo_id",
        F.col("blocker_ord").cast("int").alias("task_ord"),
        F.concat(F.lit("task-"), "id").alias("task_id"),
        F.concat(F.lit("Resolve: "), "title").alias("title"),
        effort(sev).alias("effort"),
        F.array("id").alias("related"),
        F.col("criteria"),
    )
    contract = F.col("has_contracts") & ~F.col("has_contract_tests")
    extra = F.array_compact(
        F.array(
            F.when(
                contract,
                F.struct(
                    (F.col("n") + 1).alias("task_ord"),
                    F.lit("task-add-contract-tests").alias("task_id"),
                    F.lit("Write tests for the contracts").alias("title"),
                    F.lit("L").alias("effort"),
                    F.array(F.lit("web3-no-contract-tests")).alias("related"),
                    F.array(F.lit("All contract tests succeed.")).alias("criteria"),
                ),
            ),
            F.when(
                ~F.col("hack_demo_url"),
                F.struct(
                    (F.col("n") + 2).alias("task_ord"),
                    F.lit("task-add-demo-url").alias("task_id"),
                    F.lit("Put a demo online and link to it from the README").alias("title"),
                    F.lit("M").alias("effort"),
                    F.array(F.lit("hack-no-demo")).alias("related"),
                    F.array(F.lit("The linked address answers.")).alias("criteria"),
                ),
            ),
        )
    )
    counts = shown.groupBy("repo_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counted = facts.join(counts, "repo_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    from_facts = counted.select("repo_id", F.explode(extra).alias("t")).select("repo_id", "t.*")
    return from_blockers.select(*columns).unionByName(from_facts.select(*columns))


def effort(severity: Column) -> Column:
    return F.when(severity == "critical", "L").when(severity == "high", "M").otherwise("S")
