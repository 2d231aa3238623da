"""The import graph: edges, nodes, limitations, trimmed views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.operators.intel.imports import IMPORT_LANGUAGES
from gatewright.operators.scale import top_k


def target_id(kind, target):
    return F.when(kind == "file", target).otherwise(F.concat(kind, F.lit(":"), target))


def dependency_edges(resolved: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo_id, src, dst, kind, weight, confidence, lines); with ``limit`` the first per repository.

    Unresolved imports and uncertain externals give no edge.  An edge
    leaves one file, so its lines are as many as that file's imports.
    """
    kept = resolved.where(
        (F.col("kind") != "unresolved") & (F.col("certain") | (F.col("kind") != "external"))
    )
    conf = F.when(F.col("kind") == "file", 1.0).when(F.col("kind") == "module", 0.9).otherwise(0.95)
    edges = kept.groupBy(
        "repo_id", F.col("path").alias("src"), target_id(F.col("kind"), F.col("target")).alias("dst"), "kind"
    ).agg(
        F.count(F.lit(1)).alias("weight"),
        F.min(conf).alias("confidence"),
        F.array_sort(F.collect_list("line")).alias("lines"),
    )
    return top_k(edges, ["repo_id"], [F.col("src"), F.col("dst")], limit).drop("rank")


def dependency_nodes(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo_id, id, kind, name, path) of everything that takes part in an edge."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit("file").alias("kind")),
        F.struct(F.col("dst").alias("id"), F.col("kind").alias("kind")),
    )
    rows = edges.select("repo_id", F.explode(ends).alias("n")).select("repo_id", "n.id", "n.kind").distinct()
    path = F.when(F.col("kind") == "file", F.col("id")).when(
        F.col("kind") == "module", F.regexp_replace("id", "^module:", "")
    )
    name = F.when(F.col("kind") == "external", F.regexp_replace("id", "^external:", "")).otherwise(P.basename(path))
    kind = F.when(F.col("kind") == "external", "external-dependency").otherwise(F.col("kind"))
    nodes = rows.select("repo_id", "id", kind.alias("kind"), name.alias("name"), path.alias("path"))
    return top_k(nodes, ["repo_id"], [F.col("id")], limit).drop("rank")


def graph_limitations(
    text: DataFrame, resolved: DataFrame, max_file_bytes: int | None = None, examples: int | None = None
) -> DataFrame:
    """Counts of what the graph could not cover: (repo_id, reason, language, n, examples)."""
    langs = text.withColumn("language", P.language_of(F.col("path"))).where(
        P.is_programming_language(F.col("language"))
    )
    oversize = F.lit(False) if max_file_bytes is None else F.col("size") > max_file_bytes
    reason = F.when(oversize, "oversize").when(
        ~F.col("language").isin(*IMPORT_LANGUAGES), "no-extractor"
    )
    files = langs.withColumn("reason", reason).where(F.col("reason").isNotNull())
    misses = resolved.where((F.col("kind") == "unresolved") & F.col("certain"))
    rows = files.select("repo_id", "reason", "language", F.col("path").alias("example")).unionByName(
        misses.select(
            "repo_id",
            F.lit("unresolved-import").alias("reason"),
            "language",
            F.concat_ws(":", "path", "line").alias("example"),
        )
    )
    keys = ["repo_id", "reason", "language"]
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shown = (
        top_k(rows, keys, [F.col("example")], examples)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("example")).alias("examples"))
    )
    return totals.join(shown, keys)


def graph_view(
    nodes: DataFrame,
    edges: DataFrame,
    prefix: str | None = None,
    max_nodes: int | None = None,
    max_edges: int | None = None,
    max_external: int | None = None,
) -> dict[str, DataFrame]:
    """Nodes, edges between kept nodes, externals, and the accounting of each.

    Without ``max_nodes`` the ends of an edge tell by themselves whether both are kept.
    """
    external = nodes.where(F.col("kind") == "external-dependency").select("repo_id", "name").distinct()
    inner = nodes.where((F.col("kind") != "external-dependency") & P.under_prefix(F.col("id"), prefix))
    kept = top_k(inner, ["repo_id"], [F.col("id")], max_nodes)
    ends = (F.col("kind") != "external") & P.under_prefix(F.col("src"), prefix) & P.under_prefix(F.col("dst"), prefix)
    inside = edges.where(ends)
    if max_nodes is not None:
        ids = kept.select("repo_id", "id")
        inside = inside.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(
            ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi"
        )
    section = F.when(F.col("kind") == "external-dependency", "externals").when(P.under_prefix(F.col("id"), prefix), "nodes")
    counted = nodes.select("repo_id", section.alias("section")).where(F.col("section").isNotNull())
    counted = counted.unionByName(inside.select("repo_id", F.lit("edges").alias("section")))
    limits = F.create_map(
        *[x for k, v in (("nodes", max_nodes), ("edges", max_edges), ("externals", max_external)) for x in (F.lit(k), F.lit(v).cast("long"))]
    )
    cut = F.coalesce(F.element_at(limits, F.col("section")), F.col("total"))
    account = counted.groupBy("repo_id", "section").agg(F.count(F.lit(1)).alias("total")).select(
        "repo_id", "section", F.least("total", cut).alias("returned"), "total", F.greatest(F.col("total") - cut, F.lit(0)).alias("omitted")
    )
    return {
        "nodes": kept,
        "edges": top_k(inside, ["repo_id"], [F.col("src"), F.col("dst")], max_edges),
        "externals": top_k(external, ["repo_id"], [F.col("name")], max_external),
        "accounting": account,
    }


def trimmed(rows: DataFrame, limit: int | None, label: str) -> DataFrame:
    """returned / total / omitted per repository, from a count alone."""
    total = F.count(F.lit(1))
    cut = F.col("total") if limit is None else F.lit(limit)
    return rows.groupBy("repo_id").agg(total.alias("total")).select(
        "repo_id",
        F.lit(label).alias("section"),
        F.least(F.col("total"), cut).alias("returned"),
        "total",
        F.greatest(F.col("total") - cut, F.lit(0)).alias("omitted"),
    )
