"""Result tables: partitioned Parquet with dynamic overwrite, and last-wins upsert."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run's tables below ``spark.checkpoint.dir``, which all executors share.

    Only in local mode, where one machine is the cluster, a folder of our own takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gw-shared-")
    return f"{root.rstrip('/')}/gw-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """``df`` written below ``folder`` and read back, which cuts its lineage; as it is without a folder."""
    if folder is None:
        return df
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite only the partitions present in ``df`` (all of it when unpartitioned)."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def repo_bucket(buckets: int = 256):
    """Partition column for tables keyed by repository: spreads repositories evenly."""
    return F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int").alias("repo_bucket")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key.  An aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``current`` without a change, plus the last change per key."""
    fresh = latest_per_key(changes, keys, order)
    kept = current.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)


def upsert_batch(path: str, keys: list[str], order: list[str]):
    """``foreachBatch`` sink with last-wins semantics.

    Changes are written to ``path/delta/v=<batch>``, so a replayed batch overwrites its own folder and nothing is lost
    when an executor dies in the middle of a write.  `compact` folds them into a base from time to time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{path}/delta/v={batch_id}")

    return write


def _finished(spark: SparkSession, folder: str, column: str) -> list[int]:
    """The numbers n of the folders ``folder/<column>=n`` whose write came to its end."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    there = [n for n in names if n.startswith(f"{column}=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in there)


def read_upserted(spark: SparkSession, path: str, keys: list[str], schema: StructType | None = None) -> DataFrame:
    """The table that an `upsert_batch` sink keeps: its newest base and the changes since.

    With its ``schema``, a table without any change yet is empty.
    """
    bases = _finished(spark, f"{path}/base", "b")
    since = bases[-1] if bases else -1
    deltas = [v for v in _finished(spark, f"{path}/delta", "v") if v > since]
    if schema is not None and not deltas and not bases:
        return spark.createDataFrame([], schema)
    parts = []
    if deltas:
        reader = spark.read.option("basePath", f"{path}/delta")
        parts.append(reader.parquet(*(f"{path}/delta/v={v}" for v in deltas)).withColumn("v", F.col("v").cast("long")))
    if bases:
        base = spark.read.parquet(f"{path}/base/b={since}").drop("bucket")
        if not parts:
            return base
        parts.append(base.withColumn("v", F.lit(since).cast("long")).select(parts[0].columns))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (latest_per_key(rows, keys, ["v"]) if len(deltas) + len(bases) > 1 else rows).drop("v")


def compact(spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
    """Fold the changes so far into a new base of hash buckets, so that a read looks at one version of a key.

    A base is used once its write has come to its end; readers of older files are not disturbed.
    """
    deltas = _finished(spark, f"{path}/delta", "v")
    if not deltas or deltas[-1] in _finished(spark, f"{path}/base", "b"):
        return
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = read_upserted(spark, path, keys).withColumn("bucket", bucket)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/b={deltas[-1]}")
