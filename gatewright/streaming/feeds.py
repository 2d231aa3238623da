"""Streaming queries over commit, job, request and verdict feeds.

Every function takes a streaming (or batch) DataFrame and returns one; the
caller chooses source, sink and checkpoint folder.  `run_available` drives a
query over everything present and stops, which also gives the incremental
nightly form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatewright import dims as D
from gatewright.operators import history, jobs

COMMIT_SCHEMA = "repo_id string, sha string, subject string, ts timestamp, filename string, patch string"


def read_commits(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(COMMIT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def secret_introductions(
    commits: DataFrame, floor: float = D.ENTROPY_FLOOR, min_length: int = D.MIN_TOKEN_LENGTH
) -> DataFrame:
    """Earliest commit per secret, for update mode.

    The scan itself is stateless; state is one row per distinct (repo, kind,
    file, reason).  A late, older commit revises the introducer, so the state
    cannot be dropped by a watermark.
    """
    return history.earliest_hits(history.history_line_hits(commits, floor, min_length))


JOB_SCHEMA = "job_id string, status string, attempts long, version long"
OUTCOMES = ("completed", "failed")


def _advance(status: str, attempts: int, event: str, retryable: bool, retry_limit: int) -> tuple[str, int]:
    """One legal transition; anything else leaves the job as it is."""
    if status == "queued" and event == "processing":
        return "processing", attempts + 1
    if status == "processing" and event == "completed":
        return "completed", attempts
    if status == "processing" and event == "failed":
        return ("queued" if retryable and attempts <= retry_limit else "failed"), attempts
    return status, attempts


def _event_time(events: DataFrame, late: str | None) -> tuple[DataFrame, str]:
    """With ``late`` events under a watermark, so that state older than it is settled; else all state is kept."""
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("ts", late)
    return timed.withColumn("at", F.unix_micros("ts")), timeout


_SINCE = -(1 << 62)


def _settled_until(state: GroupState, late: str | None) -> int:
    """Microseconds before which no event can come any more."""
    return _SINCE if late is None else state.getCurrentWatermarkMs() * 1000


def job_states(events: DataFrame, retry_limit: int = 2, late: str | None = None) -> DataFrame:
    """Current state per job, for update mode, whatever the order in which events arrive.

    A job's state is its set of distinct events in order of time, and the status and attempts that those settled by the
    watermark lead to; the events since are folded anew when one arrives late.  ``version`` grows with every change.
    """
    events, timeout = _event_time(events, late)
    schema = "status string, attempts long, version long, at array<long>, event array<string>, retryable array<boolean>"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, version, *columns = state.get if state.exists else ("queued", 0, 0, [], [], [])
        known = set(zip(*columns))
        for rows in batches:
            known.update(zip(rows["at"].tolist(), rows["event"].tolist(), rows["retryable"].map(bool).tolist()))
        # The starting event of a time goes before its outcomes.
        ordered = sorted(known, key=lambda e: (e[0], e[1] != "processing", e[1] == "completed", e[2]))
        settled = _settled_until(state, late)
        kept = [e for e in ordered if e[0] >= settled]
        for _, event, retryable in ordered[: len(ordered) - len(kept)]:
            status, attempts = _advance(status, attempts, event, retryable, retry_limit)
        now, tries = status, attempts
        for _, event, retryable in kept:
            now, tries = _advance(now, tries, event, retryable, retry_limit)
        state.update((status, attempts, version + 1, *map(list, zip(*kept))) if kept else (status, attempts, version + 1, [], [], []))
        yield pd.DataFrame([(key[0], now, tries, version + 1)], columns=["job_id", "status", "attempts", "version"])

    return events.groupBy("job_id").applyInPandasWithState(fold, JOB_SCHEMA, schema, "update", timeout)


def dedupe_stream(requests: DataFrame, key: str = "idempotency_key", late: str = "1 hour") -> DataFrame:
    """First request per key within the lateness bound; state expires with the watermark."""
    return requests.withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])


def activity_stream(audit_jobs: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return jobs.activity_windows(audit_jobs.withWatermark("created_at", late), size)


ALERT_SCHEMA = "repo_id string, at long, ship boolean, was_ship boolean, stands boolean, version long"


def _flips(last: bool | None, verdicts: list[tuple[int, bool]]) -> set[tuple[int, bool]]:
    """(time, flag) of the verdicts that turn over the one before; ``last`` is the flag before the first."""
    out = set()
    for ts, ship in verdicts:
        if last is not None and ship != last:
            out.add((ts, ship))
        last = ship
    return out


def gate_alerts(verdicts: DataFrame, late: str | None = None) -> DataFrame:
    """ship / blocked flips per repository from a feed (repo_id, ts, ship), in update mode and any order of arrival.

    A verdict that arrives late can make flips that earlier alerts did not know, and undo flips that they reported:
    such an alert comes again with ``stands`` false.  Of the rows with one (repo_id, ts, ship) that with the highest
    ``version`` counts.  State is the ordered verdicts that the watermark has not settled, and the flag before them.
    """
    kind = verdicts.schema["ts"].dataType
    verdicts, timeout = _event_time(verdicts, late)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version, *columns = state.get if state.exists else (None, 0, [], [])
        before = sorted(zip(*columns))
        known = set(before)
        for rows in batches:
            known.update(zip(rows["at"].tolist(), rows["ship"].map(bool).tolist()))
        ordered = sorted(known)
        old, new = _flips(last, before), _flips(last, ordered)
        changes = [(ts, ship, True) for ts, ship in sorted(new - old)] + [(ts, ship, False) for ts, ship in sorted(old - new)]
        settled = _settled_until(state, late)
        kept = [v for v in ordered if v[0] >= settled]
        if len(kept) < len(ordered):
            last = ordered[len(ordered) - len(kept) - 1][1]
        state.update((last, version + 1, [ts for ts, _ in kept], [ship for _, ship in kept]))
        yield pd.DataFrame(
            [(key[0], ts, ship, not ship, stands, version + 1) for ts, ship, stands in changes],
            columns=["repo_id", "at", "ship", "was_ship", "stands", "version"],
        )

    schema = "last boolean, version long, at array<long>, ship array<boolean>"
    found = verdicts.groupBy("repo_id").applyInPandasWithState(fold, ALERT_SCHEMA, schema, "update", timeout)
    return found.select("repo_id", F.timestamp_micros("at").cast(kind).alias("ts"), "ship", "was_ship", "stands", "version")


def gate_alerts_batch(verdicts: DataFrame) -> DataFrame:
    """The same flips over a table: each verdict against the one before it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("repo_id").orderBy("ts", "ship")
    return (
        verdicts.withColumn("was_ship", F.lag("ship").over(w))
        .where(F.col("was_ship") != F.col("ship"))
        .select("repo_id", "ts", "ship", "was_ship")
    )


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder the cluster names in spark.checkpoint.dir; ``fallback`` only where unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return root


def stream_folder(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """The folder of a named stream: the same in every run, so that a run goes on where the last one stopped."""
    return f"{checkpoint_root(spark, fallback).rstrip('/')}/gw-streams/{name}"


def run_available(
    stream: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None]
) -> None:
    """Process everything currently available in restartable micro-batches, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
