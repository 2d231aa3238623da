"""Audit-history tables, and their streaming forms run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.operators import findings as fm
from gatewright.operators import jobs, scoring, secrets
from gatewright.operators import gate as gates
from gatewright.plans import audit
from gatewright.queries import content, views
from gatewright.queries import sql as S
from gatewright.queries.registry import query, table, view
from gatewright.sources.tables import read_upserted, run_folder, stored, upsert_batch
from gatewright.streaming import feeds


@query(
    "audit_history",
    "SELECT repo_id, job_id, CAST(overall AS DOUBLE) AS overall, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id) AS rank FROM audit_jobs WHERE status = 'completed')",
)
def audit_history(spark, d):
    return jobs.audit_history(view(spark, d, "audit_jobs")).select("repo_id", "job_id", "overall", "rank")


_FOLD = """WITH RECURSIVE e0 AS (SELECT DISTINCT job_id, ts, event, retryable FROM job_events_x WHERE event <> 'queued'),
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event DESC) AS n FROM e0),
j AS (SELECT DISTINCT job_id FROM job_events_x),
s(job_id, n, status, attempts) AS (SELECT job_id, CAST(0 AS BIGINT), 'queued', CAST(0 AS BIGINT) FROM j
 UNION ALL SELECT s.job_id, e.n, CASE WHEN s.status = 'queued' AND e.event = 'processing' THEN 'processing' WHEN s.status = 'processing' AND e.event = 'completed' THEN 'completed'
   WHEN s.status = 'processing' AND e.event = 'failed' THEN CASE WHEN e.retryable AND s.attempts <= 2 THEN 'queued' ELSE 'failed' END ELSE s.status END,
   s.attempts + CASE WHEN s.status = 'queued' AND e.event = 'processing' THEN 1 ELSE 0 END FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1)
SELECT job_id, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts FROM s GROUP BY 1"""
_FOLD = _FOLD.replace("job_events_x", f"({views.oracle('SELECT * FROM job_events')})")


@query("job_rollup", _FOLD)
def job_rollup(spark, d):
    return jobs.job_rollup(view(spark, d, "job_events")).select("job_id", "status", "attempts")


@query(
    "classify_errors",
    "SELECT job_id, CASE WHEN regexp_matches(error, 'rate limit|429|403') THEN 'UPSTREAM_RATE_LIMITED' WHEN regexp_matches(error, '(?i)not found|404') THEN 'REPO_NOT_FOUND' WHEN regexp_matches(error, '(?i)invalid input|validation') THEN 'INVALID_INPUT' WHEN regexp_matches(error, '(?i)host not allowed') THEN 'HOST_NOT_ALLOWED' WHEN error IS NOT NULL THEN 'UPSTREAM_FAILED' END AS error_code,"
    " CASE WHEN error IS NOT NULL THEN regexp_matches(error, 'rate limit|429|403') OR NOT regexp_matches(error, '(?i)not found|404|invalid input|validation|host not allowed') END AS retryable FROM audit_jobs",
)
def classify_errors(spark, d):
    return jobs.classify_errors(view(spark, d, "audit_jobs")).select("job_id", "error_code", "retryable")


@query(
    "dedupe_requests",
    "SELECT job_id, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, job_id) AS n FROM audit_jobs) WHERE idempotency_key IS NULL OR n = 1",
)
def dedupe_requests(spark, d):
    return jobs.dedupe_requests(view(spark, d, "audit_jobs")).select("job_id", "idempotency_key")


_KEY = """'v1:' || sha256('{"commitSha":' || coalesce('"' || commitSha || '"', 'null') || ',"includeLaunchCopy":' || CASE WHEN includeLaunchCopy THEN 'true' ELSE 'false' END || ',"mode":"' || mode || '","outputLanguage":"' || outputLanguage || '","owner":"' || owner || '","repo":"' || repo || '","reportVersion":"' || reportVersion || '","target":"' || target || '"}')"""


@query("audit_key", f"SELECT event_id, {_KEY} AS key FROM requests")
def audit_key(spark, d):
    return view(spark, d, "requests").select("event_id", jobs.audit_key().alias("key"))


@query(
    "pending_audits",
    f"""WITH k AS (SELECT event_id, ts, {_KEY} AS key FROM requests), st AS (SELECT key, max(ts) + INTERVAL 1 HOUR AS expires_at FROM k WHERE 'j' || event_id IN (SELECT job_id FROM audit_jobs WHERE status = 'completed') GROUP BY 1),
now AS (SELECT max(ts) - INTERVAL 10 DAY AS t FROM k), v AS (SELECT key FROM st, now WHERE expires_at > now.t)
SELECT 'todo' AS part, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM v) UNION ALL SELECT 'reusable', count(*) FROM k WHERE key IN (SELECT key FROM v)
UNION ALL SELECT 'expired', count(*) FROM st, now WHERE expires_at <= now.t""",
)
def pending_audits(spark, d):
    wanted = view(spark, d, "requests").select("event_id", "ts", jobs.audit_key().alias("key"))
    stored = (
        wanted.withColumn("job_id", F.concat(F.lit("j"), F.col("event_id").cast("string")))
        .join(view(spark, d, "audit_jobs").where("status = 'completed'").select("job_id"), "job_id", "left_semi")
        .groupBy("key")
        .agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"))
        .select("key", F.lit(jobs.KEY_VERSION).alias("key_version"), "expires_at", F.lit(0).alias("hits"))
    )
    # "Now" is ten days before the newest request: one value, computed by Spark and joined as a scalar.
    now = wanted.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("now"))
    stored = stored.crossJoin(F.broadcast(now))
    parts = jobs.pending_audits(wanted, stored, F.col("now"))
    out = None
    for name in ("todo", "reusable", "expired"):
        rows = parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "audit_activity_windows",
    "SELECT repo_id, time_bucket(INTERVAL 1 DAY, created_at) AS window_start, count(*) AS audits, count(*) FILTER (WHERE status = 'failed') AS failures, round(avg(overall), 6) AS mean_overall FROM audit_jobs GROUP BY 1, 2",
)
def audit_activity_windows(spark, d):
    out = jobs.activity_windows(view(spark, d, "audit_jobs"))
    return out.withColumn("mean_overall", F.round("mean_overall", 6))


@query(
    "audit_activity_sessions",
    "WITH g AS (SELECT repo_id, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM audit_jobs WINDOW w AS (PARTITION BY repo_id ORDER BY created_at)), k AS (SELECT *, sum(s) OVER (PARTITION BY repo_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT repo_id, min(created_at) AS session_start, count(*) AS audits FROM k GROUP BY repo_id, n",
)
def audit_activity_sessions(spark, d):
    return jobs.activity_sessions(view(spark, d, "audit_jobs")).drop("session_end")


# --- flagship ---------------------------------------------------------------------------------------
@query(
    "document_gate",
    f"""WITH {content._DOC_LINES}, {content._tokens("dl")},
h AS (SELECT DISTINCT repo_id, path, line FROM ve WHERE h >= 3.5 AND NOT {content._TEMPLATE} AND {content._SHAPE} IS NULL),
f AS (SELECT repo_id, path, line, {S.severity_for("path", "'medium'")} AS severity FROM h),
p AS (SELECT repo_id, CASE severity WHEN 'medium' THEN 5.0 ELSE 1.5 END AS w, row_number() OVER (PARTITION BY repo_id, path ORDER BY CASE severity WHEN 'medium' THEN 5.0 ELSE 1.5 END DESC) AS n FROM f),
s AS (SELECT repo_id, count(*) AS findings, sum(CASE WHEN n <= 3 THEN w ELSE 0 END) AS penalty FROM p GROUP BY 1), r AS (SELECT DISTINCT source AS repo_id FROM documents)
SELECT r.repo_id, coalesce(findings, 0) AS findings, CAST(greatest(0.0, floor((100.0 - coalesce(penalty, 0)) * 10 + 0.5) / 10) AS DOUBLE) AS security, true AS ship FROM r LEFT JOIN s ON s.repo_id = r.repo_id""",
)
def document_gate(spark: SparkSession, d: str) -> DataFrame:
    """The secret scanner alone: every document scanned, findings, score of the security dimension, gate."""
    files = view(spark, d, "doc_files").select("repo_id", "path", "list_pos", "content")
    repos = files.select("repo_id").distinct()
    hits = secrets.secret_hits(files, floor=3.5)
    # Narrow next to the text, and read by scoring and by the gate: written once, so the text is scanned once.
    found = stored(fm.enrich_findings(secrets.secret_findings(hits)), run_folder(spark), "findings")
    routed = found.withColumn("bucket", F.lit("security"))
    penalty = scoring.severity_penalty(routed)
    rules = penalty.select(
        "repo_id", "dimension", F.lit("severity-penalty").alias("rule"), (-F.col("penalty")).alias("delta"), F.lit("").alias("reason")
    )
    scores = scoring.score_dimensions(repos, rules).select("repo_id", F.col("securityHygiene").alias("security"))
    checks = gates.gate_checks(repos, gates.gate_findings(found))
    verdict = gates.gate_verdict(checks).select("repo_id", "ship")
    counts = penalty.select("repo_id", F.col("count").alias("findings"))
    return (
        scores.join(verdict, "repo_id").join(counts, "repo_id", "left")
        .select("repo_id", F.coalesce("findings", F.lit(0)).alias("findings"), "security", "ship")
    )


@query("document_audit")
def document_audit(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit over the document corpus: all scanners, facts, findings, scores and gate of every repository."""
    rows = view(spark, d, "doc_files")
    result = audit.audit(rows.select("repo_id", "path", "size", "list_pos"), rows.select("repo_id", "path", "content"), folder=run_folder(spark))
    counts = result.findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings"))
    verdict = result.verdict.select("repo_id", "status", "ship", "blockers")
    return (
        result.scores.select("repo_id", "overall", "documentation", "reproducibility", "securityHygiene", "deploymentReadiness")
        .join(verdict, "repo_id")
        .join(counts, "repo_id", "left")
    )


# --- streams ------------------------------------------------------------------------------------------
def _stream(spark: SparkSession, d: str, name: str) -> str:
    """A driver table, one file or a folder of them, as a file stream under a view name the view SQL can use.

    Spark streams no single file, but it streams what a pattern matches; this one matches the table alone.
    """
    schema = table(spark, d, name).schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    label = f"gw_stream_{name}"
    raw.createOrReplaceTempView(label)
    return label


def _run(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str], order: list[str]) -> DataFrame:
    """Run to the end of the data into an upsert table in a new folder below the shared one."""
    base = run_folder(spark)
    feeds.run_available(stream, f"{base}/state", mode, upsert_batch(f"{base}/out", keys, order))
    return read_upserted(spark, f"{base}/out", keys, stream.schema)


@query(
    "stream_secret_scan",
    f"WITH {content._HIST} SELECT repo_id, 'generic_high_entropy' AS kind, file, sha, line FROM hf WHERE n = 1",
)
def stream_secret_scan(spark, d):
    label = _stream(spark, d, "documents")
    commits = spark.sql(views.spark_sql("commit_files", lambda t: label))
    commits = commits.withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600)).drop("seq")
    out = _run(
        spark, feeds.secret_introductions(commits, floor=3.5), "update", ["repo_id", "kind", "file", "reason"], ["ts", "sha"]
    )
    return out.select("repo_id", "kind", "file", "sha", "line")


@query("stream_job_states", _FOLD)
def stream_job_states(spark, d):
    label = _stream(spark, d, "events")
    events = spark.sql(views.spark_sql("job_events", lambda t: label))
    return _run(spark, feeds.job_states(events), "update", ["job_id"], ["version"]).select("job_id", "status", "attempts")


_FLIPS = "WITH v AS (SELECT DISTINCT repo_id, created_at AS ts, overall >= 40 AS ship FROM audit_jobs), l AS (SELECT *, lag(ship) OVER (PARTITION BY repo_id ORDER BY ts, ship) AS was_ship FROM v) SELECT repo_id, ts, ship, was_ship FROM l WHERE was_ship <> ship"


def _verdicts(rows: DataFrame) -> DataFrame:
    return rows.select("repo_id", F.col("created_at").alias("ts"), (F.col("overall") >= 40).alias("ship"))


@query("stream_gate_alerts", _FLIPS)
def stream_gate_alerts(spark, d):
    label = _stream(spark, d, "events")
    verdicts = _verdicts(spark.sql(views.spark_sql("audit_jobs", lambda t: label)))
    out = _run(spark, feeds.gate_alerts(verdicts), "update", ["repo_id", "ts", "ship"], ["version"])
    return out.where("stands").select("repo_id", "ts", "ship", "was_ship")


@query("gate_alerts", _FLIPS)
def gate_alerts(spark, d):
    return feeds.gate_alerts_batch(_verdicts(view(spark, d, "audit_jobs")).distinct())
