"""Languages and listed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.operators.admission import classify_files
from gatewright.operators.scale import top_k


def text_files(tree: DataFrame) -> DataFrame:
    return classify_files(tree).where(F.col("kind") == "text").drop("kind")


def language_usage(text: DataFrame) -> DataFrame:
    """Files and bytes per (repo, language) with its rank by bytes, files, name."""
    rows = text.withColumn("language", P.language_of(F.col("path"))).where(F.col("language").isNotNull())
    usage = rows.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("bytes")
    )
    # At most as many rows per repository as there are languages.
    order = [F.col("bytes").desc(), F.col("file_count").desc(), F.col("language")]
    return top_k(usage, ["repo_id"], order, len(set(D.LANGUAGE_BY_EXTENSION.values())))


def primary_language(usage: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Top programming language, else top language, else the metadata's."""
    prog = P.is_programming_language(F.col("language"))
    best = usage.groupBy("repo_id").agg(
        F.min_by("language", F.struct(~prog, F.col("rank"))).alias("detected")
    )
    if repos is None:
        return best.withColumnRenamed("detected", "primary_language")
    return repos.join(best, "repo_id", "left").select(
        "repo_id", F.coalesce("detected", "primary_language").alias("primary_language")
    )


LISTS = {"config": P.is_config, "test": P.is_test_file, "documentation": P.is_documentation}


def listed_files(text: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo_id, list, rank, path, total): the paths of each list (with ``limit`` the first) and their number."""
    member = F.array_compact(F.array(*[F.when(f(F.col("path")), F.lit(n)) for n, f in LISTS.items()]))
    rows = text.select("repo_id", "path", F.explode(member).alias("list"))
    totals = rows.groupBy("repo_id", "list").agg(F.count(F.lit(1)).alias("total"))
    first = top_k(rows, ["repo_id", "list"], [F.col("path")], limit)
    return first.join(totals, ["repo_id", "list"])
