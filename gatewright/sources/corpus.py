"""Corpus sources: file trees and file contents of many repositories.

Layouts
    repo_tree   repo_id, path, size, list_pos
    repo_files  repo_id, path, content          (admitted and read files only)

``repo_id`` names one snapshot of one repository.  A listed file need not be
read, so content is always left-joined: null content means "unknown", never
"empty".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gatewright.operators.admission import file_kind

TREE_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("list_pos", T.LongType(), False),
    ]
)
FILES_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.StringType(), True),
    ]
)


def read_tree(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(TREE_SCHEMA).load(path)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(FILES_SCHEMA).load(path)


def read_checkouts(spark: SparkSession, root: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Checked-out repositories below ``root/<repo_id>/...`` as (tree, files).

    Only the path and length columns are touched for the tree, so the binary
    source does not load contents there; ``files`` reads only what classifies as
    text.  Listing order is path order.  Bytes that are no UTF-8 become U+FFFD.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    clean_root = root.rstrip("/").removeprefix("file:")
    inside = F.regexp_replace(F.substring_index("path", clean_root + "/", -1), r"^/+", "")
    keyed = raw.withColumn("repo_id", F.substring_index(inside, "/", 1)).withColumn(
        "rel", F.regexp_replace(inside, r"^[^/]+/", "")
    )
    tree = keyed.select(
        "repo_id",
        F.col("rel").alias("path"),
        F.col("length").cast("bigint").alias("size"),
        F.row_number().over(Window.partitionBy("repo_id").orderBy("rel")).cast("bigint").alias("list_pos"),
    )
    files = keyed.where(file_kind(F.col("rel"), F.col("length")) == "text").select(
        "repo_id",
        F.col("rel").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
    return tree, files


def attach_content(tree: DataFrame, files: DataFrame) -> DataFrame:
    """Left join on the well-spread key (repo_id, path)."""
    return tree.join(files.select("repo_id", "path", "content"), ["repo_id", "path"], "left")


def parse_repo_url(urls: DataFrame, allowed_hosts: list[str], url_col: str = "url") -> DataFrame:
    """Adds host, owner, repo and error (null when the URL is accepted)."""
    raw = F.trim(F.col(url_col))
    parsed = F.regexp_replace(raw, r"\.git\z", "")
    host = F.lower(F.regexp_extract(parsed, r"(?i)^https://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(parsed, r"(?i)^https://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    owner, repo = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    legal = r"^[A-Za-z0-9._-]+\z"
    allowed = [h.lower() for h in allowed_hosts]
    error = (
        F.when(~raw.rlike(r"(?i)^https://[^/?#\s]+"), F.lit("not-https"))
        .when(F.size(parts) < 2, F.lit("missing-owner-or-repo"))
        .when(~owner.rlike(legal) | ~repo.rlike(legal), F.lit("illegal-characters"))
        .when(~host.isin(*allowed), F.lit("host-not-allowed"))
    )
    ok = error.isNull()
    return urls.select(
        "*",
        F.when(ok, host).alias("host"),
        F.when(ok, owner).alias("owner"),
        F.when(ok, repo).alias("repo"),
        error.alias("error"),
    )


def strip_archive_root(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Drop a shared first segment when that makes more wanted paths match.

    ``wanted(repo_id, path)`` holds the paths the caller expects.  Each listed
    path is probed as is and without its first segment by one equi-join; the
    per-repository decision is one aggregated row.
    """
    first = F.substring_index("path", "/", 1)
    nested = F.instr("path", "/") > 1
    rest = F.expr("substring(path, instr(path, '/') + 1)")
    probes = tree.select(
        "repo_id",
        F.explode(
            F.array(
                F.struct(F.col("path").alias("probe"), F.lit(0).alias("stripped")),
                F.struct(F.when(nested, rest).alias("probe"), F.lit(1).alias("stripped")),
            )
        ).alias("p"),
    ).select("repo_id", F.col("p.probe").alias("path"), "p.stripped")
    matches = (
        probes.where(F.col("path").isNotNull())
        .join(wanted.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        .groupBy("repo_id")
        .agg(
            F.sum(F.col("stripped").cast("bigint")).alias("stripped_matches"),
            F.sum(F.lit(1) - F.col("stripped")).alias("as_is_matches"),
        )
    )
    shape = tree.groupBy("repo_id").agg(
        F.bool_and(nested).alias("all_nested"),
        F.min(first).alias("lo"),
        F.max(first).alias("hi"),
    )
    decision = shape.join(matches, "repo_id", "left").select(
        "repo_id",
        (
            F.col("all_nested")
            & (F.col("lo") == F.col("hi"))
            & (F.coalesce("stripped_matches", F.lit(0)) > F.coalesce("as_is_matches", F.lit(0)))
        ).alias("strip"),
    )
    return (
        tree.join(decision, "repo_id")
        .withColumn("path", F.when(F.col("strip"), rest).otherwise(F.col("path")))
        .drop("strip")
    )
