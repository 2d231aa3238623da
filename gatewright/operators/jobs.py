"""Audit-history tables: job state, errors, request identity, incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewright.operators.scale import top_k

# Fields of the audit key in order, and its version.
KEY_FIELDS = ["commitSha", "includeLaunchCopy", "mode", "outputLanguage", "owner", "repo", "reportVersion", "target"]
KEY_VERSION = "v1"
# (code, pattern on the message, retryable); the first test is case-sensitive.
ERROR_RULES = [
    ("UPSTREAM_RATE_LIMITED", r"rate limit|429|403", True),
    ("REPO_NOT_FOUND", r"(?i)not found|404", False),
    ("INVALID_INPUT", r"(?i)invalid input|validation", False),
    ("HOST_NOT_ALLOWED", r"(?i)host not allowed", False),
]
DEFAULT_ERROR = ("UPSTREAM_FAILED", True)


def classify_errors(errors: DataFrame, column: str = "error") -> DataFrame:
    message = F.col(column)
    code, retry = None, None
    for name, pattern, again in ERROR_RULES:
        hit = message.rlike(pattern)
        code = F.when(hit, name) if code is None else code.when(hit, name)
        retry = F.when(hit, F.lit(again)) if retry is None else retry.when(hit, F.lit(again))
    known = message.isNotNull()
    return errors.select(
        "*",
        F.when(known, code.otherwise(DEFAULT_ERROR[0])).alias("error_code"),
        F.when(known, retry.otherwise(F.lit(DEFAULT_ERROR[1]))).alias("retryable"),
    )


def audit_key() -> Column:
    """``v1:`` + SHA-256 of the canonical JSON of the eight request fields."""
    payload = F.to_json(F.struct(*[F.col(f) for f in KEY_FIELDS]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(KEY_VERSION + ":"), F.sha2(payload, 256))


def audit_history(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Completed audits per repository, newest first, with their rank; with ``limit`` the newest of them."""
    order = [F.col("created_at").desc(), F.col("job_id")]
    return top_k(jobs.where(F.col("status") == "completed"), ["repo_id"], order, limit)


def job_rollup(events: DataFrame, retry_limit: int = 2) -> DataFrame:
    """Current state per job from its events (job_id, repo_id, ts, event, retryable).

    Legal transitions are queued -> processing -> completed / failed, so legal
    events alternate between a start and an outcome: of a run of events of one
    class only the first counts, and outcomes before the first start do not
    count at all.  An outcome ends the job when it is a completion, a failure
    that cannot be retried, or a failure with all attempts used up.  Repeated
    deliveries of one event collapse before the windows.
    """
    start = F.col("event") == "processing"
    created = events.groupBy("job_id").agg(F.min("repo_id").alias("repo_id"), F.min("ts").alias("created_at"))
    steps = (
        events.where(F.col("event").isin("processing", "completed", "failed"))
        .groupBy("job_id", "ts", "event")
        .agg(F.bool_and("retryable").alias("retryable"))
    )
    w = Window.partitionBy("job_id").orderBy("ts", F.col("event").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    legal = (
        steps.withColumn("prev_start", F.lag(start).over(w))
        .where(F.when(F.col("prev_start").isNull(), start).otherwise(F.col("prev_start") != start))
        .withColumn("attempt", F.count_if(start).over(upto))
    )
    ends = (F.col("event") == "completed") | (
        (F.col("event") == "failed") & (~F.col("retryable") | (F.col("attempt") > retry_limit))
    )
    marked = legal.withColumn("ended", F.coalesce(F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    last = (
        marked.where(~F.col("ended"))
        .withColumn("ends", ends)
        .groupBy("job_id")
        .agg(
            F.max("attempt").alias("attempts"),
            F.max_by(F.struct("event", "ends", "ts"), F.struct("ts", F.col("attempt"), (~start).cast("int"))).alias("l"),
        )
    )
    status = (
        F.when(F.col("l").isNull(), "queued")
        .when(F.col("l.event") == "processing", "processing")
        .when(F.col("l.event") == "completed", "completed")
        .when(F.col("l.ends"), "failed")
        .otherwise("queued")
    )
    return created.join(last, "job_id", "left").select(
        "job_id",
        "repo_id",
        status.alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        "created_at",
        F.when(F.col("l.event") == "completed", F.col("l.ts")).alias("completed_at"),
    )


def dedupe_requests(requests: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """First request per key; requests without a key all stay.

    An aggregate over an ordered struct: retries of one key combine map-side.
    """
    rest = [c for c in requests.columns if c != key]
    keyed = requests.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("r"))
    return first.select(key, "r.*").select(*requests.columns).unionByName(requests.where(F.col(key).isNull()))


def pending_audits(wanted: DataFrame, stored: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Which requests still need work.

    ``wanted(key, ...)``; ``stored(key, key_version, expires_at, hits)``.
    Validity is a predicate on the stored side, so both answers are plain
    anti/semi joins on the audit key.
    """
    valid = stored.where((F.col("key_version") == KEY_VERSION) & (F.col("expires_at") > now)).select("key")
    reusable = wanted.join(valid, "key", "left_semi")
    return {
        "todo": wanted.join(valid, "key", "left_anti"),
        "reusable": reusable,
        "expired": stored.where(F.col("expires_at") <= now),
        "reuse_counts": reusable.groupBy("key").agg(F.count(F.lit(1)).alias("reuses")),
    }


def activity_windows(jobs: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Audits, failures and mean overall per repository and time window (our addition)."""
    window = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return jobs.groupBy("repo_id", window.alias("w")).agg(
        F.count(F.lit(1)).alias("audits"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.avg("overall").alias("mean_overall"),
    ).select("repo_id", F.col("w.start").alias("window_start"), "audits", "failures", "mean_overall")


def activity_sessions(jobs: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Bursts of audits per repository, closed after ``gap`` without one (our addition)."""
    session = F.session_window("created_at", gap)
    return jobs.groupBy("repo_id", session.alias("w")).agg(F.count(F.lit(1)).alias("audits")).select(
        "repo_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "audits"
    )


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Counts over every combination of category, severity and rule (our addition)."""
    return findings.cube("category", "severity", "rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.grouping_id().alias("level")
    )
