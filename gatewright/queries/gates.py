"""Findings model, scoring, gate, comparison and fix plans over derived findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators import diff, fixplan, gate, presence, report, scoring
from gatewright.operators import findings as fm
from gatewright.plans import audit as plan
from gatewright.queries import scans
from gatewright.queries import sql as S
from gatewright.queries.registry import query, view
from gatewright.sources.tables import run_folder, stored


def _findings(spark, d, side: int | None = None, **more) -> DataFrame:
    """Drafts from the findings view, with ``more`` columns; ``side`` 0 is the base audit, 1 the head."""
    rows = view(spark, d, "findings")
    if side is not None:
        rows = rows.where(F.col("side").isin(side, 2))
    return rows.select(
        "repo_id", "section", "ord", "id", F.lit("meta").alias("category"), "severity",
        F.concat(F.lit("Title of "), "id").alias("title"),
        F.array(fm.evidence(F.col("file"), F.col("line"), "seen")).alias("evidence"),
        F.concat(F.lit("Fix "), "id").alias("action"),
        F.array(F.lit("gone"), F.concat(F.lit("checked "), "id")).alias("criteria"),
        *[value.alias(name) for name, value in more.items()],
    )


def _enriched(spark, d, side: int | None = None) -> DataFrame:
    return fm.enrich_findings(_findings(spark, d, side))


_F = f"""f AS (SELECT *, {S.rule_id('id')} AS rule_id FROM findings),
fk AS (SELECT *, {S.fnv("rule_id || '|' || file || ':' || CAST(line AS VARCHAR)")} AS key FROM f)"""
_REAL = f"real AS (SELECT * FROM fk WHERE NOT {S.hit('file', D.FIXTURE_PATH)})"


@query("map_rule", f"SELECT repo_id, id, ord, {S.rule_id('id')} AS rule_id, {S.rule_source('id')} AS rule_source FROM findings")
def map_rule(spark, d):
    return fm.map_rules(_findings(spark, d)).select("repo_id", "id", "ord", "rule_id", "rule_source")


@query("fingerprint", f"WITH {_F} SELECT repo_id, id, ord, key AS fingerprint FROM fk")
def fingerprint(spark, d):
    return _enriched(spark, d).select("repo_id", "id", "ord", "fingerprint")


@query(
    "enrich_findings",
    f"WITH {_F} SELECT repo_id, id, rule_id, {S.rule_source('id')} AS source, CAST(CASE WHEN rule_id IN ('SEC-INJECTION-001', 'AI-DUP-001') THEN 0.7 WHEN rule_id IN ('TEST-001', 'DEP-MANIFEST-001') THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence, count(*) AS n FROM f GROUP BY ALL",
)
def enrich_findings(spark, d):
    out = _enriched(spark, d)
    return out.groupBy(
        "repo_id", "id", "rule_id", F.get("evidence", F.lit(0))["source"].alias("source"), "confidence"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_fixtures",
    f"SELECT repo_id, {S.hit('file', D.FIXTURE_PATH)} AS fixture, count(*) AS n FROM findings GROUP BY ALL",
)
def split_fixtures(spark, d):
    real, fixtures = fm.split_fixtures(_findings(spark, d))
    rows = real.withColumn("fixture", F.lit(False)).unionByName(fixtures.withColumn("fixture", F.lit(True)))
    return rows.groupBy("repo_id", "fixture").agg(F.count(F.lit(1)).alias("n"))


_DEPLOY = f"((section = 'repro' AND {S.any_of('id', D.DEPLOYMENT_IDS)}) OR (section = 'web3' AND starts_with(id, 'web3-')))"
_BUCKETS = {
    "documentation": "section = 'doc'",
    "reproducibility_all": "section = 'repro'",
    "reproducibility": f"(section = 'repro' AND NOT {_DEPLOY}) OR section = 'hygiene'",
    "security": "section = 'security'",
    "deployment": _DEPLOY,
    "web3": "section = 'web3'",
    "hackathon": "section = 'hack'",
    "quality": "section = 'quality'",
}
_ROUTED = "routed AS (" + " UNION ALL ".join(
    f"SELECT *, '{b}' AS bucket, {i} AS list_ord FROM real WHERE {c}" for i, (b, c) in enumerate(_BUCKETS.items())
) + ")"


def _routed(spark, d, side: int | None = None) -> DataFrame:
    return fm.route_findings(fm.split_fixtures(_enriched(spark, d, side))[0])


@query("route_findings", f"WITH {_F}, {_REAL}, {_ROUTED} SELECT repo_id, bucket, count(*) AS n FROM routed GROUP BY ALL")
def route_findings(spark, d):
    return _routed(spark, d).groupBy("repo_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


_GROUPS = f"""g AS (SELECT repo_id, file, rule_id, count(*) AS count, min({S.rank('severity')}) AS r,
 min_by('Title of ' || id, (ord, id)) AS title, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM f GROUP BY ALL)"""


@query(
    "group_findings",
    f"WITH {_F}, {_GROUPS} SELECT repo_id, file, rule_id, count, {S.severity_of_rank('r')} AS severity, title, lines FROM g",
)
def group_findings(spark, d):
    out = fm.group_findings(_enriched(spark, d))
    return out.withColumn("lines", F.array_join("lines", ","))


@query(
    "condense_evidence",
    f"""WITH {_F}, {_GROUPS}, o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY r, lower(file), file, rule_id) AS n, count(*) OVER (PARTITION BY repo_id) AS gs, sum(count) OVER (PARTITION BY repo_id) AS fs,
 title || CASE WHEN count > 1 THEN ' ×' || CAST(count AS VARCHAR) ELSE '' END || ' in ' || file AS t FROM g),
s AS (SELECT repo_id, string_agg(t, '; ' ORDER BY n) AS shown, any_value(gs) AS gs, any_value(fs) AS fs, sum(count) AS c FROM o GROUP BY 1)
SELECT repo_id, shown AS lines FROM s""",
)
def condense_evidence(spark, d):
    out = fm.condense_evidence(fm.group_findings(_enriched(spark, d)))
    return out.select("repo_id", F.array_join("lines", "; ").alias("lines"))


_BLOCK = f"""sev AS (SELECT *, CASE bucket WHEN 'documentation' THEN 1 WHEN 'reproducibility_all' THEN 2 WHEN 'security' THEN 3 WHEN 'deployment' THEN 4 WHEN 'web3' THEN 5 WHEN 'hackathon' THEN 6 END AS bo
 FROM routed WHERE severity IN ('critical', 'high')),
blockers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {S.rank('severity')}, bo, ord, id, line) AS blocker_ord FROM sev WHERE bo IS NOT NULL))"""


@query(
    "collect_blockers",
    f"WITH {_F}, {_REAL}, {_ROUTED}, {_BLOCK} SELECT repo_id, blocker_ord, id, bucket, severity FROM blockers",
)
def collect_blockers(spark, d):
    return fm.collect_blockers(_routed(spark, d)).select("repo_id", "blocker_ord", "id", "bucket", "severity")


@query(
    "severity_penalty",
    f"""WITH {_F}, {_REAL}, {_ROUTED}, p AS (SELECT repo_id, CASE bucket WHEN 'security' THEN 'securityHygiene' WHEN 'deployment' THEN 'deploymentReadiness' ELSE bucket END AS dimension, file, rule_id,
 CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 5.0 ELSE 1.5 END AS w FROM routed WHERE bucket IN ('documentation', 'reproducibility', 'security', 'deployment')),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, dimension, file, rule_id ORDER BY w DESC) AS n FROM p)
SELECT repo_id, dimension, CAST(sum(CASE WHEN n <= 3 THEN w ELSE 0 END) AS DOUBLE) AS penalty, count(*) AS count, CAST(sum(CASE WHEN n > 3 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM r GROUP BY ALL""",
)
def severity_penalty(spark, d):
    return scoring.severity_penalty(_routed(spark, d))


# --- scores from the facts of the derived corpus --------------------------------------------------
_FACT_COLUMNS = {
    **{flag: S.any_of("path", names) for _, flag, _, _, names in D.REQUIRED_DOCS},
    "has_screenshots": S.hit("path", D.SCREENSHOT),
    "has_lockfile": f"admitted AND {S.any_of('path', D.LOCKFILES)}",
    "has_ci": f"admitted AND {S.hit('path', D.CI_WORKFLOW)}",
    "has_docker": f"admitted AND {S.hit('path', D.DOCKER_PATH)}",
    "has_demo_url": f"path = 'README.md' AND {S.hit('content', D.README_URL)}",
    "has_test_command": "CASE WHEN path = 'package.json' AND json_valid(content) THEN coalesce(json_extract_string(content, '$.scripts.test'), '') <> '' OR coalesce(json_extract_string(content, '$.scripts.\"test:unit\"'), '') <> '' END",
    "has_run_command": "CASE WHEN path = 'package.json' AND json_valid(content) THEN coalesce(json_extract_string(content, '$.scripts.dev'), '') <> '' OR coalesce(json_extract_string(content, '$.scripts.start'), '') <> '' END",
    "has_contracts": scans._OWN + " AND " + S.hit("path", D.CONTRACT_DIR) + " AND " + S.hit("path", D.CONTRACT_FILE),
    "has_deploy_scripts": scans._OWN + " AND " + S.hit("path", D.DEPLOY_PATH),
    "has_contract_tests": scans._OWN + " AND " + S.hit("path", D.CONTRACT_TEST),
    "has_audit_note": scans._OWN + " AND " + S.hit("path", D.AUDIT_NOTE),
    "hack_demo_url": f"{scans._ONSUB} AND len(list_filter(regexp_extract_all(content, {S.q(D.URL)}), LAMBDA u: regexp_matches(u, {S.q(D.DEMO_HOST)}))) > 0",
    "hack_demo_video": f"{scans._ONSUB} AND len(list_filter(regexp_extract_all(content, {S.q(D.URL)}), LAMBDA u: regexp_matches(u, {S.q(D.VIDEO_HOST)}))) > 0",
    "hack_architecture": f"{scans._ONSUB} AND {S.hit('content', D.ARCHITECTURE_HEADING)}",
    "hack_license": S.hit("path", D.HACK_LICENSE_PATH),
    "hack_network": " OR ".join(
        [f"({scans._ONCHAIN} AND {S.hit('content', rx)})" for rx in D.CHAIN_KEYWORDS.values()]
        + [f"({scans._ONSUB} AND {S.hit('content', rx)})" for rx in D.NETWORK_KEYWORDS.values()]
    ),
}
_FACTS = (
    f"{S.CORPUS}, facts AS (SELECT repo_id, "
    + ", ".join(f"coalesce(bool_or({v}), false) AS {k}" for k, v in _FACT_COLUMNS.items())
    + " FROM corpus GROUP BY repo_id)"
)
_FLAG_RULES = "flagged AS (" + " UNION ALL ".join(
    f"SELECT repo_id, '{dim}' AS dimension, '{rule}' AS rule, CAST({delta} AS DOUBLE) AS delta, {S.q(reason)} AS reason FROM facts WHERE {cond}"
    for dim, rule, delta, cond, reason in D.FLAG_RULES
) + ")"


@query("score_flag_rules", f"WITH {_FACTS}, {_FLAG_RULES} SELECT * FROM flagged")
def score_flag_rules(spark, d):
    return scoring.flag_rules(scans.facts(spark, d))


# Penalties come from the findings view; repositories r<n> exist on both sides.
_PEN = """pen AS (SELECT repo_id, dimension, sum(CASE WHEN n <= 3 THEN w ELSE 0 END) AS penalty, count(*) AS c, sum(CASE WHEN n > 3 THEN 1 ELSE 0 END) AS dropped FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id, dimension, file, rule_id ORDER BY w DESC) AS n FROM (SELECT repo_id, CASE bucket WHEN 'security' THEN 'securityHygiene' WHEN 'deployment' THEN 'deploymentReadiness' ELSE bucket END AS dimension, file, rule_id,
  CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 5.0 ELSE 1.5 END AS w FROM routed WHERE bucket IN ('documentation', 'reproducibility', 'security', 'deployment'))) GROUP BY ALL)"""
_RULES = f"""{_F}, {_REAL}, {_ROUTED}, {_PEN}, {_FACTS}, {_FLAG_RULES},
rules AS (SELECT * FROM flagged UNION ALL SELECT repo_id, dimension, 'severity-penalty', CAST(-penalty AS DOUBLE), 'Penalty from ' || CAST(c AS VARCHAR) || ' ' || CASE dimension WHEN 'securityHygiene' THEN 'security' WHEN 'deploymentReadiness' THEN 'deployment' ELSE dimension END || ' finding(s)' || CASE WHEN dropped > 0 THEN '; at most 3 counted per file and rule' ELSE '' END FROM pen),
dims AS (SELECT f.repo_id, """ + ", ".join(
    f"greatest(0.0, least(100.0, floor((100.0 + coalesce(sum(CASE WHEN dimension = '{x}' THEN delta END), 0.0)) * 10 + 0.5) / 10)) AS \"{x}\"" for x in D.DIMENSIONS
) + " FROM facts f LEFT JOIN rules r ON r.repo_id = f.repo_id GROUP BY 1)"


def _score_inputs(spark, d):
    facts = scans.facts(spark, d)
    return facts, scoring.score_rules(facts, scoring.severity_penalty(_routed(spark, d)))


@query("score_rules", f"WITH {_RULES} SELECT * FROM rules")
def score_rules(spark, d):
    return _score_inputs(spark, d)[1]


@query("score_dimensions", f"WITH {_RULES} SELECT * FROM dims")
def score_dimensions(spark, d):
    facts, rules = _score_inputs(spark, d)
    return scoring.score_dimensions(facts, rules)


_BOOST = " + ".join(f"CASE WHEN {k} THEN {v} ELSE 0 END" for k, v in D.HACKATHON_BOOST.items())
_OVERALL = "overall AS (" + " UNION ALL ".join(
    f"SELECT dims.repo_id, '{t}' AS target, greatest(0.0, least(100.0, floor((0.0 + "
    + " + ".join(f'"{x}" * CAST({w[x]} AS DOUBLE)' for x in D.DIMENSIONS)
    + (f" + {_BOOST}" if t == "hackathon" else "")
    + ") * 10 + 0.5) / 10)) AS overall FROM dims JOIN facts ON facts.repo_id = dims.repo_id"
    for t, w in D.TARGET_WEIGHTS.items()
) + ")"


@query("score_overall", f"WITH {_RULES}, {_OVERALL} SELECT * FROM overall")
def score_overall(spark, d):
    facts, rules = _score_inputs(spark, d)
    dims = scoring.score_dimensions(facts, rules)
    return scoring.score_overall(dims, facts, list(D.TARGET_WEIGHTS)).select("repo_id", "target", "overall")


# --- gate ----------------------------------------------------------------------------------------
def _gate_sql(side: int | None, p: str = "") -> str:
    where = "" if side is None else f"WHERE side IN ({side}, 2)"
    n = lambda *r: f"count(*) FILTER (WHERE {S.any_of('rule_id', r)})"
    own = f"NOT {S.hit('file', D.FIXTURE_PATH)} AND severity IN ('critical', 'high')"
    checks = [
        ("security", "security.no-secrets", "secrets <= 0", "SEC-SECRET-001"),
        ("security", "security.no-history-secrets", "history <= 0", "SEC-HISTORY-001"),
        ("security", "security.no-critical", "critical <= 0", None),
        ("testing", "testing.test-script", "t = 0", "TEST-002"),
        ("ci", "ci.workflow", "ci = 0", "CI-001"),
        ("repository", "repository.readme", "rd = 0", "REPO-README-001"),
        ("repository", "repository.license", "lc = 0", "REPO-LICENSE-001,HACK-LICENSE-001"),
        ("release", "release.build-path", "dk = 0 OR rn = 0", "BUILD-001,BUILD-002"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT repo_id, '{sec}' AS section, '{cid}' AS check_id, CASE WHEN {ok} THEN 'pass' ELSE 'fail' END AS status, "
        + (f"'{rules}'" if rules else "crit_rules") + f" AS rule_ids FROM {p}tot"
        for sec, cid, ok, rules in checks
    )
    return f"""{p}gf AS (SELECT repo_id, key, id, min(rule_id) AS rule_id, min_by(severity, (ord, {S.rank('severity')})) AS severity, any_value(file) AS file FROM fk {where} GROUP BY 1, 2, 3),
{p}tot AS (SELECT repo_id, count(*) FILTER (WHERE rule_id = 'SEC-SECRET-001' AND {own}) AS secrets, count(*) FILTER (WHERE rule_id = 'SEC-HISTORY-001' AND {own}) AS history,
 count(*) FILTER (WHERE severity = 'critical') AS critical, coalesce(string_agg(DISTINCT CASE WHEN severity = 'critical' THEN rule_id END, ',' ORDER BY CASE WHEN severity = 'critical' THEN rule_id END), '') AS crit_rules,
 {n("TEST-002")} AS t, {n("CI-001")} AS ci, {n("REPO-README-001")} AS rd, {n("REPO-LICENSE-001", "HACK-LICENSE-001")} AS lc, {n("BUILD-001")} AS dk, {n("BUILD-002")} AS rn FROM {p}gf GROUP BY 1),
{p}checks AS ({rows}),
{p}verdict AS (SELECT repo_id, count(*) FILTER (WHERE status = 'fail') AS blockers FROM {p}checks GROUP BY 1),
{p}bk AS (SELECT DISTINCT g.repo_id, g.key FROM {p}gf g JOIN (SELECT repo_id, unnest(string_split(rule_ids, ',')) AS rule_id FROM {p}checks WHERE status = 'fail') x ON x.repo_id = g.repo_id AND x.rule_id = g.rule_id)"""


def _gate(spark, d, folder: str | None = None):
    found = stored(gate.gate_findings(_enriched(spark, d)), folder, "findings")
    repos = found.select("repo_id").distinct()
    return found, gate.gate_checks(repos, found)


def _gated_sides(spark, d) -> list[DataFrame]:
    """Verdicts of the base and of the head, then their blocking keys.

    Both audits go through the gate in one pass, so a finding of both gets its rule and its key once.  What several
    steps read is written once and read back.
    """
    by, folder = ["repo_id", "audit"], run_folder(spark)
    of = lambda side, *numbers: (F.col("side") == side, F.array(*map(F.lit, numbers)))
    audits = F.when(*of(2, 0, 1)).when(*of(0, 0)).when(*of(1, 1))
    repos = view(spark, d, "findings").select("repo_id", F.explode(audits).alias("audit")).distinct()
    rows = fm.enrich_findings(_findings(spark, d, audits=audits)).withColumn("audit", F.explode("audits"))
    found = stored(gate.gate_findings(rows, by).drop("id"), folder, "findings")
    checks = stored(gate.gate_checks(repos, found, by=by), folder, "checks")
    verdicts, keys = gate.gate_verdict(checks, by), gate.blocking_keys(checks, found, by)
    return [t.where(F.col("audit") == n).drop("audit") for t in (verdicts, keys) for n in (0, 1)]


@query("gate_findings", f"WITH {_F}, {_gate_sql(None)} SELECT repo_id, key, id, rule_id, severity FROM gf")
def gate_findings(spark, d):
    return gate.gate_findings(_enriched(spark, d)).drop("in_fixture")


@query("gate_checks", f"WITH {_F}, {_gate_sql(None)} SELECT * FROM checks")
def gate_checks(spark, d):
    out = _gate(spark, d)[1]
    return out.select("repo_id", "section", "check_id", "status", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(
    "gate_sections",
    f"WITH {_F}, {_gate_sql(None)} SELECT repo_id, section, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS status, count(*) AS checks FROM checks GROUP BY ALL",
)
def gate_sections(spark, d):
    return gate.gate_sections(_gate(spark, d)[1])


@query(
    "gate_verdict",
    f"WITH {_F}, {_gate_sql(None)} SELECT repo_id, blockers, CAST(0 AS BIGINT) AS warnings, CASE WHEN blockers > 0 THEN 'blocked' ELSE 'pass' END AS status, blockers = 0 AS ship FROM verdict",
)
def gate_verdict(spark, d):
    return gate.gate_verdict(_gate(spark, d)[1])


@query("blocking_fingerprints", f"WITH {_F}, {_gate_sql(None)} SELECT repo_id, key FROM bk")
def blocking_fingerprints(spark, d):
    found, checks = _gate(spark, d, run_folder(spark))
    return gate.blocking_keys(checks, found)


@query(
    "compare_gates",
    f"""WITH {_F}, {_gate_sql(0, "b_")}, {_gate_sql(1, "h_")},
k AS (SELECT coalesce(b.repo_id, h.repo_id) AS repo_id, count(*) FILTER (WHERE h.key IS NULL) AS resolved, count(*) FILTER (WHERE b.key IS NULL) AS added, count(*) FILTER (WHERE b.key IS NOT NULL AND h.key IS NOT NULL) AS remaining
 FROM b_bk b FULL JOIN h_bk h ON b.repo_id = h.repo_id AND b.key = h.key GROUP BY 1)
SELECT b.repo_id, b.blockers AS before_blockers, h.blockers AS after_blockers, coalesce(resolved, 0) AS resolved, coalesce(added, 0) AS added, coalesce(remaining, 0) AS remaining,
 (b.blockers = 0) <> (h.blockers = 0) AS ship_changed FROM b_verdict b JOIN h_verdict h ON h.repo_id = b.repo_id LEFT JOIN k ON k.repo_id = b.repo_id""",
)
def compare_gates(spark, d):
    out = gate.compare_gates(*_gated_sides(spark, d))
    return out.select("repo_id", "before_blockers", "after_blockers", "resolved", "added", "remaining", "ship_changed")


# --- diff ----------------------------------------------------------------------------------------
_FIX_LISTS = f"""lists AS (SELECT *, 0 AS lo FROM fk WHERE severity IN ('critical', 'high') UNION ALL SELECT *, 1 FROM fk WHERE section = 'doc' UNION ALL SELECT *, 2 FROM fk WHERE section = 'security'),
fixable AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY lo, ord, {S.rank('severity')}, file, line) AS n FROM lists) WHERE n = 1)"""


def _fixable(spark, d) -> DataFrame:
    rows = _enriched(spark, d)
    lists = (
        rows.where(F.col("severity").isin("critical", "high")).withColumn("list_ord", F.lit(0))
        .unionByName(rows.where(F.col("section") == "doc").withColumn("list_ord", F.lit(1)))
        .unionByName(rows.where(F.col("section") == "security").withColumn("list_ord", F.lit(2)))
    )
    return diff.fixable_findings(lists)


@query("fixable_findings", f"WITH {_F}, {_FIX_LISTS} SELECT repo_id, id, severity, lo AS list_ord FROM fixable")
def fixable_findings(spark, d):
    return _fixable(spark, d).select("repo_id", "id", "severity", "list_ord")


def _side_sql(side: int, p: str) -> str:
    return f"{p} AS (SELECT * FROM (SELECT repo_id, key, id, rule_id, file, line, severity, row_number() OVER (PARTITION BY repo_id, key ORDER BY {S.rank('severity')} DESC, id DESC) AS n FROM fk WHERE side IN ({side}, 2)) WHERE n = 1)"


_STATUS = f"""{_side_sql(0, "bs")}, {_side_sql(1, "hs")},
st AS (SELECT coalesce(h.repo_id, b.repo_id) AS repo_id, coalesce(h.key, b.key) AS key, CASE WHEN h.key IS NULL THEN 'resolved' WHEN b.key IS NULL THEN 'new' ELSE 'persistent' END AS status,
 coalesce(h.rule_id, b.rule_id) AS rule_id, coalesce(h.file, b.file) AS file, coalesce(h.line, b.line) AS line FROM bs b FULL JOIN hs h ON h.repo_id = b.repo_id AND h.key = b.key)"""


@query("finding_status", f"WITH {_F}, {_STATUS} SELECT repo_id, key, status, rule_id, file, line FROM st")
def finding_status(spark, d):
    out = diff.finding_status(_enriched(spark, d, 0), _enriched(spark, d, 1))
    return out.select("repo_id", "key", "status", "rule_id", "file", "line")


@query("moved_findings")
def moved_findings(spark, d):
    return diff.moved_findings(diff.finding_status(_enriched(spark, d, 0), _enriched(spark, d, 1)))


def _side_penalties(spark, d, side: int):
    return scoring.severity_penalty(_routed(spark, d, side)).select(
        "repo_id", "dimension", F.lit("severity-penalty").alias("rule"), (-F.col("penalty")).alias("delta"),
        F.lit("p").alias("reason"),
    )


def _pen_sql(side: int, p: str) -> str:
    return f"""{p} AS (SELECT repo_id, dimension, -sum(CASE WHEN n <= 3 THEN w ELSE 0 END) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, dimension, file, rule_id ORDER BY w DESC) AS n FROM (
 SELECT repo_id, CASE bucket WHEN 'security' THEN 'securityHygiene' WHEN 'deployment' THEN 'deploymentReadiness' ELSE bucket END AS dimension, file, rule_id, CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 5.0 ELSE 1.5 END AS w
 FROM routed WHERE bucket IN ('documentation', 'reproducibility', 'security', 'deployment') AND side IN ({side}, 2))) GROUP BY ALL)"""


@query(
    "rule_deltas",
    f"WITH {_F}, {_REAL}, {_ROUTED}, {_pen_sql(0, 'b')}, {_pen_sql(1, 'h')}, j AS (SELECT coalesce(b.repo_id, h.repo_id) AS repo_id, coalesce(b.dimension, h.dimension) AS dimension, coalesce(b.delta, 0) AS before, coalesce(h.delta, 0) AS after FROM b FULL JOIN h ON b.repo_id = h.repo_id AND b.dimension = h.dimension) SELECT repo_id, dimension, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CAST(floor((after - before) * 10 + 0.5) / 10 AS DOUBLE) AS delta FROM j WHERE floor((after - before) * 10 + 0.5) <> 0",
)
def rule_deltas(spark, d):
    return diff.rule_deltas(_side_penalties(spark, d, 0), _side_penalties(spark, d, 1)).drop("rule", "reason")


def _scores_of(spark, d, side: int) -> DataFrame:
    rules = _side_penalties(spark, d, side).withColumn("delta", F.col("delta") / 100)
    repos = view(spark, d, "findings").select("repo_id").distinct()
    dims = scoring.score_dimensions(repos, rules)
    flags = repos.select("repo_id", *[F.lit(False).alias(x) for x in D.HACKATHON_BOOST])
    return scoring.score_overall(dims, flags, ["open_source"])


def _dims_sql(p: str) -> str:
    cols = ", ".join(
        f"greatest(0.0, least(100.0, floor((100.0 + coalesce(sum(CASE WHEN dimension = '{x}' THEN CAST(delta AS DOUBLE) / 100 END), 0.0)) * 10 + 0.5) / 10)) AS {p}{i}"
        for i, x in enumerate(D.DIMENSIONS)
    )
    return f"{p}d AS (SELECT a.repo_id, {cols} FROM (SELECT DISTINCT repo_id FROM findings) a LEFT JOIN {p} ON {p}.repo_id = a.repo_id GROUP BY 1), {p}o AS (SELECT *, floor((0.0 + {p}0 * 0.3::DOUBLE + {p}1 * 0.3::DOUBLE + {p}2 * 0.25::DOUBLE + {p}3 * 0.15::DOUBLE) * 10 + 0.5) / 10 AS {p}all FROM {p}d)"


_R1 = lambda e: f"floor(({e}) * 10 + 0.5) / 10"


@query(
    "score_deltas",
    f"WITH {_F}, {_REAL}, {_ROUTED}, {_pen_sql(0, 'b')}, {_pen_sql(1, 'h')}, {_dims_sql('b')}, {_dims_sql('h')} SELECT bo.repo_id, {_R1('hall - ball')} AS overall_delta, "
    + ", ".join(f'{_R1(f"h{i} - b{i}")} AS "{x}_delta"' for i, x in enumerate(D.DIMENSIONS))
    + f", CASE WHEN {_R1('hall - ball')} > 0 THEN 'improved' WHEN {_R1('hall - ball')} < 0 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM bo JOIN ho ON ho.repo_id = bo.repo_id",
)
def score_deltas(spark, d):
    return diff.score_deltas(_scores_of(spark, d, 0), _scores_of(spark, d, 1)).drop("target")


@query(
    "metrics_drift",
    """WITH m AS (SELECT repo_id, audit AS side, count(*) AS n, sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS c, max(line) AS l, bool_or(id LIKE 'secret-history%') AS h
 FROM (SELECT *, unnest(CASE WHEN side = 2 THEN [0, 1] ELSE [side] END) AS audit FROM findings) GROUP BY 1, 2),
a AS (SELECT repo_id, h, unnest(['total', 'critical', 'last_line']) AS metric, unnest([CAST(n AS DOUBLE), c, l]) AS v, side FROM m),
j AS (SELECT coalesce(b.repo_id, h.repo_id) AS repo_id, coalesce(b.metric, h.metric) AS metric, b.v AS before, h.v AS after, coalesce(b.h AND h.h, false) AS comparable FROM (SELECT * FROM a WHERE side = 0) b FULL JOIN (SELECT * FROM a WHERE side = 1) h ON b.repo_id = h.repo_id AND b.metric = h.metric)
SELECT *, after - before AS delta FROM j WHERE before IS DISTINCT FROM after""",
)
def metrics_drift(spark, d):
    audits = F.when(F.col("side") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("side").cast("int")))
    rows = view(spark, d, "findings").withColumn("side", F.explode(audits))
    metrics = rows.groupBy("repo_id", "side").agg(
        F.bool_or(F.col("id").startswith("secret-history")).alias("history_scanned"),
        F.count(F.lit(1)).cast("double").alias("total"),
        F.count_if(F.col("severity") == "critical").cast("double").alias("critical"),
        F.max("line").cast("double").alias("last_line"),
    )
    side = lambda n: metrics.where(F.col("side") == n).drop("side")
    return diff.metrics_drift(side(1), side(0), ["total", "critical", "last_line"])


# --- fix plans -----------------------------------------------------------------------------------
_CAND = f"""gr AS (SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id, file ORDER BY {S.rank('severity')}, id) AS g FROM fixable),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {S.rank('severity')}, id) AS plan_ord FROM gr WHERE g = 1))"""


@query("fix_plan_candidates", f"WITH {_F}, {_FIX_LISTS}, {_CAND} SELECT repo_id, plan_ord, id, severity, file FROM cand")
def fix_plan_candidates(spark, d):
    out = fixplan.fix_plan_candidates(_fixable(spark, d))
    return out.select("repo_id", "plan_ord", "id", "severity", fm.first_file().alias("file"))


@query(
    "fix_plans",
    f"""WITH {_F}, {_FIX_LISTS}, {_CAND} SELECT repo_id, 'fixplan:' || id AS plan_id, CASE WHEN severity IN ('critical', 'high') THEN 'P0' WHEN severity = 'medium' THEN 'P1' ELSE 'P2' END AS priority,
 CASE severity WHEN 'critical' THEN 'L' WHEN 'high' THEN 'M' ELSE 'S' END AS effort, 'Title of ' || id || '. seen' AS why, 'Fix ' || id || ' > gone > checked ' || id AS steps,
 'tests/general/' || regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') || '.test.ts' AS test FROM cand""",
)
def fix_plans(spark, d):
    out = fixplan.fix_plans(fixplan.fix_plan_candidates(_fixable(spark, d)))
    return out.select(
        "repo_id", "plan_id", "priority", "effort", "why",
        F.array_join(F.transform("steps", lambda s: s["action"]), " > ").alias("steps"),
        F.get("tests_to_add", F.lit(0)).alias("test"),
    )


@query(
    "findings_rollup",
    f"WITH {_F} SELECT section AS category, severity, rule_id, count(*) AS findings, CAST(grouping(section, severity, rule_id) AS BIGINT) AS level FROM f GROUP BY CUBE (section, severity, rule_id)",
)
def findings_rollup(spark, d):
    from gatewright.operators.jobs import findings_rollup as rollup

    return rollup(_enriched(spark, d).drop("category").withColumnRenamed("section", "category"))


# --- whole audits ----------------------------------------------------------------------------------
def _audit(spark, d) -> plan.Audit:
    return plan.audit(view(spark, d, "tree"), view(spark, d, "files"), targets=tuple(D.TARGET_WEIGHTS), folder=run_folder(spark))


@query("recommended_tasks")
def recommended_tasks(spark, d):
    facts = scans.facts(spark, d)
    drafts = presence.doc_findings(facts).unionByName(presence.repro_findings(facts))
    drafts = drafts.unionByName(presence.web3_findings(facts)).unionByName(presence.hackathon_findings(facts))
    routed = fm.route_findings(fm.split_fixtures(fm.enrich_findings(drafts))[0])
    return fm.recommended_tasks(fm.collect_blockers(routed), facts)


_CHECKED = {
    "check-readme": "has_readme", "check-license": "has_license", "check-env": "has_env_example", "check-lockfile": "has_lockfile",
    "check-ci": "has_ci", "check-tests": "has_test_command", "check-secrets": "secret_lines = ''", "check-contracts-tested": "has_contract_tests",
    "check-screenshots": "has_screenshots", "check-blockers": "blocker_lines = ''",
}


@query(
    "launch_checklist",
    f"""WITH {_FACTS}, {_F}, ev AS (SELECT repo_id, coalesce(string_agg(DISTINCT file || ':' || line, ',' ORDER BY file || ':' || line) FILTER (rule_id = 'SEC-SECRET-001'), '') AS secret_lines,
 coalesce(string_agg(DISTINCT file || ':' || line, ',' ORDER BY file || ':' || line) FILTER (severity = 'critical'), '') AS blocker_lines FROM f GROUP BY 1),
fe AS (SELECT facts.*, coalesce(secret_lines, '') AS secret_lines, coalesce(blocker_lines, '') AS blocker_lines FROM facts LEFT JOIN ev ON ev.repo_id = facts.repo_id), it AS (
"""
    + " UNION ALL ".join(
        f"SELECT repo_id, {n} AS n, '{item}' AS item, {flag} AS done, {lines} AS lines FROM fe" + (" WHERE has_contracts" if item == "check-contracts-tested" else "")
        for n, (item, flag) in enumerate(_CHECKED.items())
        for lines in [{"check-secrets": "secret_lines", "check-blockers": "blocker_lines"}.get(item, "''")]
    )
    + ") SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n) - 1 AS INTEGER) AS item_ord, item, done, lines FROM it",
)
def launch_checklist(spark, d):
    """All items, with the secrets and the blockers of the findings as evidence."""
    found = _enriched(spark, d).select("repo_id", "rule_id", "severity", F.concat_ws(":", fm.first_file(), fm.first_line()).alias("at"))
    lines = lambda rows: rows.groupBy("repo_id").agg(F.array_sort(F.collect_set("at")).alias("lines"))
    secret, blocking = lines(found.where("rule_id = 'SEC-SECRET-001'")), lines(found.where("severity = 'critical'"))
    out = report.launch_checklist(scans.facts(spark, d), secret, blocking)
    shown = F.when(F.col("item").isin("check-secrets", "check-blockers"), F.array_join("evidence", ",")).otherwise("")
    return out.select("repo_id", "item_ord", "item", "done", shown.alias("lines"))


@query(
    "report_limitations",
    f"""WITH {_FACTS}, sc AS (SELECT repo_id, count(*) FILTER (section = 'security') AS scanned, max(line) > 55 AS whole, count(*) FILTER (severity = 'critical') > 2 AS cut FROM findings GROUP BY 1)
SELECT facts.repo_id, array_to_string(list_filter(['Files were read, nothing in them was run.', 'Secrets are found by patterns, which can miss some; this replaces no security review.',
 CASE WHEN scanned = 0 THEN 'Past commits were not looked at: no history.' WHEN NOT whole THEN 'Of the commits only the newest ' || scanned || ' were looked at.' END,
 CASE WHEN cut THEN 'The file list was incomplete, so some files were not looked at.' END, 'Left out on request: deploymentPlan, launchCopy.',
 CASE WHEN has_contracts THEN 'What the contracts do was not judged.' END], lambda x: x IS NOT NULL), ' ') AS limitations
FROM facts LEFT JOIN sc ON sc.repo_id = facts.repo_id""",
)
def report_limitations(spark, d):
    """The statements of a quick report; how much was scanned is told by the repository's own findings."""
    section = F.col("section") == "security"
    scope = view(spark, d, "findings").groupBy("repo_id").agg(
        F.count_if(section).alias("scanned"), (F.max("line") > 55).alias("complete"), (F.count_if(F.col("severity") == "critical") > 2).alias("truncated")
    )
    history = scope.withColumn("note", F.when(F.col("scanned") == 0, "no history"))
    out = report.report_limitations(scans.facts(spark, d), history, scope, mode="quick")
    return out.withColumn("limitations", F.array_join("limitations", " "))


@query("report_sections")
def report_sections(spark, d):
    out = plan.report_sections(_audit(spark, d))
    return out.select("repo_id", "section", "ord", "id", "rule_id", "severity", fm.first_file().alias("file"))


@query("audit_reports")
def audit_reports(spark, d):
    out = plan.reports(_audit(spark, d))
    return out.select(
        "repo_id", "target", "overall", "status", "ship", F.col("blockers_list_count").alias("blockers_listed"),
        F.col("tasks_count").alias("tasks"), F.size("checklist").alias("checklist"), "documentation_gaps_count",
        "security_findings_count", "quality_findings_count", "fixture_findings_count",
    )
