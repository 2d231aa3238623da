"""Repository context: map, symbols and import graph of every repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators import presence
from gatewright.operators.admission import classify_files
from gatewright.operators.intel import entrypoints as ep
from gatewright.operators.intel import graph, imports, inventory, manifests, modules, symbols
from gatewright.operators.scale import top_k
from gatewright.sources.tables import stored


def repo_map(corpus: DataFrame, repos: DataFrame | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    """``corpus(repo_id, path, size, list_pos, admitted, content)``; ``repos(repo_id, name, primary_language)``.

    Listing and parsed manifests are narrow and feed most sections; with ``folder`` they are written there once.
    """
    listing = stored(classify_files(corpus.drop("content")), folder, "listing")
    admitted = listing.where(F.col("admitted")).drop("kind")
    text = listing.where(F.col("admitted") & (F.col("kind") == "text")).drop("kind")
    files = corpus.where(F.col("admitted") & F.col("content").isNotNull()).select("repo_id", "path", "content")
    parsed = stored(manifests.parse_manifests(files, folder=folder), folder, "manifests")
    usage = inventory.language_usage(text)
    signals = stored(ep.entrypoint_signals(files, admitted), folder, "signals")
    entry = stored(ep.entrypoints(signals), folder, "entrypoints")
    listed = inventory.listed_files(text)
    found = stored(modules.detect_modules(text, parsed, repos, folder=folder), folder, "modules")
    contained = modules.module_files(text, found)
    edges = stored(modules.module_dependencies(found, parsed), folder, "module-edges")
    config = listed.where(F.col("list") == "config")
    return {
        "listing": listing.drop("kind"),
        "languages": usage,
        "primary_language": inventory.primary_language(usage, repos),
        "frameworks": presence.frameworks(presence.detect_stack(corpus)),
        "package_managers": manifests.package_managers(corpus.where(F.col("admitted"))),
        "entrypoints": entry,
        "detected": found,
        "modules": modules.module_importance(found, contained, edges, entry),
        "module_edges": edges,
        "important_files": ep.important_files(entry, config),
        "listed_files": listed,
        "dependencies": manifests.external_dependencies(parsed),
        "unparsed_manifests": manifests.unparsed_manifests(text),
    }


def dependency_graph(
    corpus: DataFrame, found: DataFrame | None = None, root_prefixes: DataFrame | None = None, folder: str | None = None,
    listing: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Edges, nodes and limitations; with ``folder`` the resolved imports and the edges are written there once.

    ``listing``: the corpus without contents, where it has been written already (`repo_map`).
    """
    listing = corpus.drop("content") if listing is None else listing
    files = corpus.where(F.col("admitted") & F.col("content").isNotNull()).select("repo_id", "path", "content")
    text = inventory.text_files(listing.where(F.col("admitted")))
    resolved = stored(imports.resolve_imports(imports.extract_imports(files), listing, found, root_prefixes), folder, "imports")
    edges = stored(graph.dependency_edges(resolved), folder, "edges")
    return {
        "imports": resolved,
        "edges": edges,
        "nodes": graph.dependency_nodes(edges),
        "limitations": graph.graph_limitations(text, resolved),
    }


def symbol_map(corpus: DataFrame) -> dict[str, DataFrame]:
    admitted = corpus.where(F.col("admitted"))
    files = admitted.where(F.col("content").isNotNull()).select("repo_id", "path", "content")
    text = inventory.text_files(admitted.drop("content"))
    return {"symbols": symbols.extract_symbols(files), "coverage": symbols.symbol_coverage(text, files)}


# How many of each list a context shows.
CONTEXT_LIMITS = {"modules": 20, "files": 20, "edges": 25, "dependencies": 40, "symbols": 1000}


def context_rows(parts: dict[str, DataFrame], graph_parts: dict[str, DataFrame], symbol_parts: dict[str, DataFrame]) -> DataFrame:
    """(repo_id, section, score, a, b, c): the rows of all lists of a context, the highest score first in each."""
    c, none = F.col, F.lit(None).cast("string")
    kinds = symbol_parts["symbols"].groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    lists = [
        ("modules", parts["modules"], c("importance"), c("path"), c("name"), c("kind")),
        ("files", parts["important_files"], c("importance"), c("path"), c("reason"), none),
        ("edges", graph_parts["edges"], c("weight"), c("src"), c("dst"), c("kind")),
        ("dependencies", parts["dependencies"], F.lit(0), c("manifest"), c("name"), c("kind")),
        ("symbols", kinds, c("n"), c("kind"), none, none),
    ]
    rows = [
        df.select("repo_id", F.lit(name).alias("section"), score.cast("double").alias("score"), x.alias("a"), y.alias("b"), z.alias("c"))
        for name, df, score, x, y, z in lists
    ]
    return reduce(DataFrame.unionByName, rows)


def repo_context(
    parts: dict[str, DataFrame],
    graph_parts: dict[str, DataFrame],
    symbol_parts: dict[str, DataFrame],
    limits: dict[str, int] = CONTEXT_LIMITS,
    folder: str | None = None,
) -> DataFrame:
    """One row per repository: the first modules, files, edges, dependencies and symbol counts, and the totals of each.

    All lists are one table of ranked rows, written to ``folder`` where one is given.  One pass over it counts; the
    other keeps the first of each (repository, list), which every task cuts before the shuffle, so that a row of the
    result is gathered from at most ``limits`` rows a list.
    """
    rows = stored(context_rows(parts, graph_parts, symbol_parts), folder, "context")
    section = F.col("section")
    totals = rows.groupBy("repo_id").agg(
        *[F.count_if(section == name).alias(f"{name}_total") for name in limits if name != "symbols"],
        F.coalesce(F.sum(F.when(section == "symbols", F.col("score"))), F.lit(0)).cast("long").alias("symbols_total"),
    )
    first = top_k(rows, ["repo_id", "section"], [F.col("score").desc(), F.col("a"), F.col("b"), F.col("c")], max(limits.values()))
    within = reduce(lambda ok, item: ok | ((section == item[0]) & (F.col("rank") <= item[1])), limits.items(), F.lit(False))
    entry = F.struct("rank", "score", "a", "b", "c")
    lists = first.where(within).groupBy("repo_id").agg(
        *[F.array_sort(F.collect_list(F.when(section == name, entry))).alias(name) for name in limits]
    )
    return parts["primary_language"].join(totals, "repo_id", "left").join(lists, "repo_id", "left")
