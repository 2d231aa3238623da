"""Streams over several files, out of order and stopped in between, give what the batch form gives."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gatewright.operators import jobs
from gatewright.queries import catalogue
from gatewright.sources import tables
from gatewright.streaming import feeds

START = dt.datetime(2024, 1, 1)
EVENTS = "job_id string, repo_id string, ts timestamp, event string, retryable boolean"


def write_files(spark, rows, schema, folder, names):
    """One Parquet folder for each part of the rows, in the order given."""
    size = -(-len(rows) // len(names))
    for n, name in enumerate(names):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/part={name}")


def stream(spark, schema, folder, glob="part=*"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{glob}")


@pytest.fixture(scope="module")
def verdicts():
    rng = random.Random(4)
    rows = [(f"r{n % 7}", START + dt.timedelta(minutes=rng.randrange(3000)), rng.random() < 0.5) for n in range(400)]
    return list(dict.fromkeys(rows)) + rows[:20]


def alerts(spark, source, base):
    feeds.run_available(feeds.gate_alerts(source), f"{base}/state", "update", tables.upsert_batch(f"{base}/out", ["repo_id", "ts", "ship"], ["version"]))
    out = tables.read_upserted(spark, f"{base}/out", ["repo_id", "ts", "ship"])
    return sorted(map(tuple, out.where("stands").select("repo_id", "ts", "ship", "was_ship").collect()))


def test_alerts_of_files_out_of_order(spark, verdicts, tmp_path):
    schema = "repo_id string, ts timestamp, ship boolean"
    write_files(spark, verdicts, schema, str(tmp_path / "in"), ["a", "b", "c", "d"])
    want = sorted(map(tuple, feeds.gate_alerts_batch(spark.createDataFrame(verdicts, schema).distinct()).collect()))
    assert alerts(spark, stream(spark, schema, str(tmp_path / "in")), str(tmp_path / "run")) == want and len(want) > 100


def test_alerts_go_on_after_a_stop(spark, verdicts, tmp_path):
    schema = "repo_id string, ts timestamp, ship boolean"
    half = len(verdicts) // 2
    name = f"alerts-{uuid.uuid4().hex}"  # a stream that no earlier run of the tests has begun
    base = feeds.stream_folder(spark, name, str(tmp_path / "shared"))
    assert base == feeds.stream_folder(spark, name, str(tmp_path / "shared"))
    write_files(spark, verdicts[:half], schema, str(tmp_path / "in"), ["a"])
    first = alerts(spark, stream(spark, schema, str(tmp_path / "in")), base)
    write_files(spark, verdicts[half:], schema, str(tmp_path / "in"), ["b"])
    second = alerts(spark, stream(spark, schema, str(tmp_path / "in")), base)
    want = sorted(map(tuple, feeds.gate_alerts_batch(spark.createDataFrame(verdicts, schema).distinct()).collect()))
    assert first != want and second == want


def job_events():
    rng = random.Random(5)
    kinds = ["processing", "completed", "failed", "failed", "queued"]
    return [
        (f"j{n % 12}", "r", START + dt.timedelta(minutes=rng.randrange(5000)), rng.choice(kinds), rng.random() < 0.7) for n in range(150)
    ]


def plain_states(rows, limit=2):
    states = {}
    distinct = sorted(set(rows), key=lambda r: (r[2], ["processing", "failed", "completed", "queued"].index(r[3]), r[4]))
    for job, _, _, event, retryable in distinct:
        status, tries = states.get(job, ("queued", 0))
        if status == "queued" and event == "processing":
            status, tries = "processing", tries + 1
        elif status == "processing" and event in ("completed", "failed"):
            status = "completed" if event == "completed" else "queued" if retryable and tries <= limit else "failed"
        states[job] = status, tries
    return states


def states(spark, source, base, **how):
    feeds.run_available(feeds.job_states(source, **how), f"{base}/state", "update", tables.upsert_batch(f"{base}/out", ["job_id"], ["version"]))
    return {r.job_id: (r.status, r.attempts) for r in tables.read_upserted(spark, f"{base}/out", ["job_id"]).collect()}


def test_job_states_of_files_out_of_order(spark, tmp_path):
    rows = job_events()
    write_files(spark, rows, EVENTS, str(tmp_path / "in"), ["a", "b", "c"])
    assert states(spark, stream(spark, EVENTS, str(tmp_path / "in")), str(tmp_path / "run")) == plain_states(rows)
    assert {r.job_id: r.status for r in jobs.job_rollup(spark.createDataFrame(sorted(set(rows)), EVENTS)).collect()}.keys() == plain_states(rows).keys()


def test_job_states_settle_behind_the_watermark(spark, tmp_path):
    rows = sorted(job_events(), key=lambda r: r[2])  # in order, so that nothing is late
    write_files(spark, rows, EVENTS, str(tmp_path / "in"), ["a", "b", "c"])
    source = stream(spark, EVENTS, str(tmp_path / "in"))
    assert states(spark, source, str(tmp_path / "run"), late="1 minute") == plain_states(rows)


def test_requests_and_windows_stream_like_their_batch_forms(spark, tmp_path):
    schema = "job_id string, repo_id string, created_at timestamp, status string, overall double, idempotency_key string"
    rows = [(f"j{n}", f"r{n % 3}", START + dt.timedelta(hours=n), "failed" if n % 4 else "completed", float(n), f"k{n % 9}") for n in range(40)]
    write_files(spark, rows, schema, str(tmp_path / "in"), ["a", "b"])

    def collect(streamed, name, mode):
        sink = str(tmp_path / name)
        feeds.run_available(streamed, f"{sink}/state", mode, lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/out/v={n}"))
        return spark.read.parquet(f"{sink}/out").drop("v")

    source = stream(spark, schema, str(tmp_path / "in"))
    unique = collect(feeds.dedupe_stream(source, late="100 days"), "dedupe", "append")
    assert sorted(r.job_id for r in unique.collect()) == sorted(f"j{n}" for n in range(9))
    windows = collect(feeds.activity_stream(source), "windows", "update")
    last = windows.groupBy("repo_id", "window_start").agg(F.max("audits").alias("audits"))
    batch = jobs.activity_windows(spark.createDataFrame(rows, schema)).select("repo_id", "window_start", "audits")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_upserts_compact_to_one_version(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, x string, n int"
    sink = tables.upsert_batch(path, ["k"], ["n"])
    read = lambda: sorted(map(tuple, tables.read_upserted(spark, path, ["k"]).select("k", "x", "n").collect()))
    sink(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "c", 1)], schema), 0)
    assert read() == [(1, "a", 0), (2, "c", 1)]
    sink(spark.createDataFrame([(1, "d", 2)], schema), 1)
    assert read() == [(1, "d", 2), (2, "c", 1)]
    tables.compact(spark, path, ["k"], buckets=4)
    assert read() == [(1, "d", 2), (2, "c", 1)] and "delta" not in str(tables.read_upserted(spark, path, ["k"]).inputFiles())
    sink(spark.createDataFrame([(3, "e", 3), (2, "f", 3)], schema), 2)
    sink(spark.createDataFrame([(2, "f", 3), (3, "e", 3)], schema), 2)  # a replay
    assert read() == [(1, "d", 2), (2, "f", 3), (3, "e", 3)]
    tables.compact(spark, path, ["k"], buckets=4)
    tables.compact(spark, path, ["k"], buckets=4)  # nothing new
    assert read() == [(1, "d", 2), (2, "f", 3), (3, "e", 3)]


def test_tables_overwrite_their_own_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda repos, x: spark.createDataFrame([(r, x) for r in repos], "repo_id string, x int").select("*", tables.repo_bucket(8))
    tables.write_table(rows([f"r{n}" for n in range(50)], 1), path, ["repo_bucket"])
    one = spark.read.parquet(path).where("repo_id = 'r7'").first().repo_bucket
    tables.write_table(rows(["r7"], 2), path, ["repo_bucket"])
    out = spark.read.parquet(path)
    assert [tuple(r) for r in out.where(F.col("repo_bucket") == one).collect()] == [("r7", 2, one)]
    assert out.where(F.col("repo_bucket") != one).where("x = 1").count() == out.count() - 1


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "token = " + "q7Zr2LmX9vKc4TbN8wYd" + "1HsG5pFj3RaU6eQx0MoB"


def documents(rows):
    return [(n, KEY + f"{n:04d}" if n % 2 else "plain words", "en", f"s{n % 2}", 50) for n in rows]


@pytest.mark.parametrize("folder", [False, True])
def test_streams_read_a_table_of_one_file_or_of_a_folder(spark, tmp_path, folder):
    path = f"{tmp_path}/documents.parquet"
    if folder:
        spark.createDataFrame(documents(range(6)), DOCUMENTS).repartition(3).write.parquet(path)
    else:
        spark.createDataFrame(documents(range(6)), DOCUMENTS).toPandas().to_parquet(path)
    spark.createDataFrame(documents([7]), DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet.old")
    found = catalogue.QUERIES["stream_secret_scan"](spark, str(tmp_path))
    batch = catalogue.QUERIES["history_secret_hits"](spark, str(tmp_path))
    rows = sorted((r.repo_id, r.file, r.sha) for r in found.collect())
    assert len(rows) == 3 and rows == sorted((r.repo_id, r.file, r.sha) for r in batch.collect())


def test_streams_of_an_empty_table_find_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["stream_secret_scan"](spark, str(tmp_path)).collect() == []
