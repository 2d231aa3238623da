"""The audit of a corpus: facts, findings, scores, gate and reports for every repository."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators import admission, findings as fm, gate, history, injection, presence, residue
from gatewright.operators import report, scoring, secrets
from gatewright.sources.corpus import attach_content
from gatewright.sources.tables import stored


@dataclass
class Audit:
    """Lazy result tables of one audit run, all keyed by ``repo_id``."""

    facts: DataFrame
    findings: DataFrame
    fixtures: DataFrame
    routed: DataFrame
    blockers: DataFrame
    score_rules: DataFrame
    scores: DataFrame
    gate_findings: DataFrame
    checks: DataFrame
    verdict: DataFrame
    stack: DataFrame
    scope: DataFrame | None = None
    truncated: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def corpus_of(tree: DataFrame, files: DataFrame, **limits: int) -> DataFrame:
    """Whole tree with ``admitted`` and, for admitted files that were read, ``content``."""
    return corpus_on(listing_of(tree, **limits), files)


def corpus_on(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The `corpus_of` a listing that is there already."""
    joined = attach_content(listing, files)
    return joined.withColumn("content", F.when(F.col("admitted"), F.col("content")))


def listing_of(tree: DataFrame, **limits: int) -> DataFrame:
    """The whole tree with ``admitted``; no contents."""
    graded = admission.admit_files(tree, **limits).withColumn("admitted", F.col("skip_reason").isNull())
    return graded.drop("kind", "skip_reason")


def marked_of(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The listing with what each file's contents say (`presence.file_marks`): bit sets are joined, texts are not."""
    marks = presence.file_marks(likely_text(files).select("repo_id", "path", "content"))
    return listing.join(marks, ["repo_id", "path"], "left")


def likely_text(files: DataFrame) -> DataFrame:
    """Files read that their path alone does not rule out; admission, which asks for the size too, decides later."""
    return files.where(F.col("content").isNotNull() & (admission.file_kind(F.col("path"), F.lit(0)) == "text"))


def raw_findings(
    marked: DataFrame,
    files: DataFrame,
    facts: DataFrame,
    commit_files: DataFrame | None = None,
    wordlist: DataFrame | None = None,
    entropy_floor: float = D.ENTROPY_FLOOR,
) -> DataFrame:
    """Drafts of every analyzer.  Scanners run on the files where they lie; their hits, not the texts, meet the listing."""
    texts = likely_text(files).select("repo_id", "path", "content")
    admitted = marked.where("admitted").select("repo_id", "path", "list_pos", "size")

    def placed(hits: DataFrame) -> DataFrame:
        return hits.join(admitted, ["repo_id", "path"])

    parts = [
        presence.doc_findings(facts),
        presence.repro_findings(facts),
        presence.web3_findings(facts),
        presence.hackathon_findings(facts),
        presence.hygiene_findings(marked, facts),
        secrets.secret_findings(placed(secrets.secret_hits(texts, wordlist, entropy_floor))),
        injection.injection_findings(placed(injection.injection_hits(texts)).drop("size")),
        residue.residue_findings(placed(residue.residue_hits(texts))),
    ]
    if commit_files is not None:
        hits = history.history_secret_hits(commit_files, entropy_floor, wordlist=wordlist)
        parts.append(history.history_findings(hits))
    return reduce(DataFrame.unionByName, parts)


def audit(
    tree: DataFrame,
    files: DataFrame,
    commit_files: DataFrame | None = None,
    wordlist: DataFrame | None = None,
    targets: tuple[str, ...] = ("open_source",),
    contract: dict | None = None,
    truncated: DataFrame | None = None,
    history_commits: int | None = None,
    lockfiles_from: str = "admitted",
    entropy_floor: float = D.ENTROPY_FLOOR,
    folder: str | None = None,
) -> Audit:
    """Audit every repository of ``tree``/``files`` in one job.

    With ``folder`` (shared by all executors) the facts and the enriched findings, both small next to the corpus, are
    written there once and read by every section; without it each section computes them anew.
    """
    listing = listing_of(tree)
    marked = stored(marked_of(listing, files), folder, "marked")
    facts = presence.repo_facts(marked, lockfiles_from)
    scope = None
    if commit_files is not None:
        recent = history.recent_commits(commit_files, history_commits).select("repo_id", "sha")
        scope = history.history_scope(facts, commit_files, history_commits)
        commit_files = commit_files.join(recent, ["repo_id", "sha"], "left_semi")
    facts = stored(facts, folder, "facts")
    everything = fm.enrich_findings(raw_findings(marked, files, facts, commit_files, wordlist, entropy_floor))
    everything = stored(everything, folder, "findings")
    real, fixtures = fm.split_fixtures(everything)
    routed = fm.route_findings(real)
    rules = scoring.score_rules(facts, scoring.severity_penalty(routed))
    scores = scoring.score_overall(scoring.score_dimensions(facts, rules), facts, list(targets))
    # The report's five lists: blockers, documents, security, quality, fixtures.
    listed = real.where(
        F.col("section").isin("doc", "security", "quality")
    ).unionByName(fixtures)
    blockers = fm.collect_blockers(routed)
    gated = gate.gate_findings(listed.unionByName(blockers.select(*listed.columns)))
    checks = gate.gate_checks(facts, gated, contract, truncated)
    return Audit(
        facts=facts,
        findings=real,
        fixtures=fixtures,
        routed=routed,
        blockers=blockers,
        score_rules=rules,
        scores=scores,
        gate_findings=gated,
        checks=checks,
        verdict=gate.gate_verdict(checks),
        stack=presence.detect_stack(listing, files),
        scope=scope,
        truncated=truncated,
    )


def reports(result: Audit, mode: str = "full") -> DataFrame:
    """One nested row per (repo, target)."""
    secret_groups = fm.group_findings(
        result.findings.where(F.col("rule_id") == "SEC-SECRET-001").unionByName(
            result.fixtures.where(F.col("rule_id") == "SEC-SECRET-001")
        )
    )
    blocker_groups = fm.group_findings(result.blockers)
    checklist = report.launch_checklist(
        result.facts, fm.condense_evidence(secret_groups), fm.condense_evidence(blocker_groups)
    )
    blockers = result.blockers.select("repo_id", "blocker_ord", "id", "rule_id", "severity", "title", "evidence")
    tasks = fm.recommended_tasks(result.blockers, result.facts)
    of = lambda s: result.findings.where(F.col("section") == s)
    limitations = report.report_limitations(result.facts, result.scope, result.truncated, mode)
    rows = report.assemble_reports(
        result.scores,
        result.verdict,
        {
            "blockers_list": blockers,
            "tasks": tasks,
            "checklist": checklist,
            "documentation_gaps": of("doc"),
            "security_findings": of("security"),
            "quality_findings": of("quality"),
            "fixture_findings": result.fixtures,
        },
        nested=("checklist",),
    )
    return rows.join(limitations, "repo_id", "left")


def report_sections(result: Audit) -> DataFrame:
    """The finding lists of every report as one table: repo_id, section, ord and the finding's columns."""
    columns = ["id", "rule_id", "severity", "title", "evidence", "action", "criteria"]

    def rows(df: DataFrame, section: str, ord_: str = "ord") -> DataFrame:
        return df.select("repo_id", F.lit(section).alias("section"), F.col(ord_).cast("bigint").alias("ord"), *columns)

    out = rows(result.blockers, "blockers", "blocker_ord").unionByName(rows(result.fixtures, "fixture_findings"))
    for section, name in (("doc", "documentation_gaps"), ("security", "security_findings"), ("quality", "quality_findings")):
        out = out.unionByName(rows(result.findings.where(F.col("section") == section), name))
    return out


def quality_status(result: Audit) -> DataFrame:
    """Verdict per repository together with its section statuses."""
    rows = gate.gate_sections(result.checks)
    sections = rows.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("section", "status", "checks"))).alias("sections")
    )
    return result.verdict.join(sections, "repo_id")


def fixables(result: Audit) -> DataFrame:
    """Findings a fix plan can address: blockers, document gaps, security, first per id."""
    from gatewright.operators.diff import fixable_findings

    listed = lambda df, n: df.select(*result.findings.columns).withColumn("list_ord", F.lit(n))
    lists = (
        listed(result.blockers.withColumn("ord", F.col("blocker_ord").cast("bigint")), 0)
        .unionByName(listed(result.findings.where(F.col("section") == "doc"), 1))
        .unionByName(listed(result.findings.where(F.col("section") == "security"), 2))
    )
    return fixable_findings(lists)
