"""Which files are looked at: classification, admission, byte cap, lines, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.functions import text as X
from gatewright.operators.scale import running_total, top_k


def file_kind(path: Column, size: Column) -> Column:
    """text / binary / ignore.  The order of the tests matters."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base, ext = P.basename(p), P.extension(p)
    dotfile = base.startswith(".")
    env = (base == ".env") | base.startswith(".env.")
    return (
        F.when(p.rlike(D.SKIP_DIR_ANYWHERE) | p.rlike(D.SKIP_DIR_AT_ROOT) | p.contains(".."), F.lit("ignore"))
        .when(dotfile & (env | base.isin(*D.TEXT_DOTFILES)), F.lit("text"))
        .when(dotfile, F.lit("ignore"))
        .when(P.among(ext, D.BINARY_EXTENSIONS), F.lit("binary"))
        .when(P.among(ext, D.TEXT_EXTENSIONS), F.lit("text"))
        .when(P.among(F.lower(base), D.BARE_TEXT_NAMES), F.lit("text"))
        .when(size <= D.SMALL_TEXT_BYTES, F.lit("text"))
        .otherwise(F.lit("binary"))
    )


def classify_files(tree: DataFrame) -> DataFrame:
    return tree.withColumn("kind", file_kind(F.col("path"), F.col("size")))


def admit_files(tree: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """Every listed file with ``skip_reason`` (null when admitted).

    Sizes and counts turn a file away only where the caller asks for it.  "The first N in listing order" then needs
    only the position of the N-th passing file of each repository; the tree itself is never ordered.
    """
    reason = F.when(F.col("kind") == "ignore", F.lit("noise-directory-or-hidden")).when(
        F.col("kind") == "binary", F.lit("binary-extension")
    )
    if max_file_bytes is not None:
        reason = reason.when(F.col("size") > max_file_bytes, F.lit("exceeds-max-file-bytes"))
    graded = classify_files(tree).withColumn("skip_reason", reason)
    if max_files is None:
        return graded
    passing = graded.where(F.col("skip_reason").isNull()).select("repo_id", "list_pos", "path")
    ranked = top_k(passing, ["repo_id"], [F.col("list_pos"), F.col("path")], max_files)
    cutoff = ranked.where(F.col("rank") == max_files).select(
        "repo_id", F.col("list_pos").alias("cut_pos"), F.col("path").alias("cut_path")
    )
    late = (F.col("list_pos") > F.col("cut_pos")) | (
        (F.col("list_pos") == F.col("cut_pos")) & (F.col("path") > F.col("cut_path"))
    )
    return (
        graded.join(cutoff, "repo_id", "left")
        .withColumn(
            "skip_reason",
            F.when(F.col("skip_reason").isNull() & F.coalesce(late, F.lit(False)), F.lit("exceeds-max-files"))
            .otherwise(F.col("skip_reason")),
        )
        .drop("cut_pos", "cut_path")
    )


def admitted(tree: DataFrame, **limits: int) -> DataFrame:
    return admit_files(tree, **limits).where(F.col("skip_reason").isNull()).drop("skip_reason", "kind")


def cap_total_bytes(
    tree: DataFrame, max_total: int | None = None, max_file_bytes: int | None = None, marked: bool = False
) -> DataFrame:
    """All files with the bytes listed so far (``bytes_so_far``) and, with a cap, only those before it.

    Files over a single-file limit are skipped and not counted.  The running
    sum never decreases, so "sum <= cap" is exactly the prefix before the stop.
    ``truncated`` tells whether the repository lost files to the cap.  With ``marked`` every file stays listed, and
    ``kept`` tells whether both limits let it through.
    """
    fits = F.lit(True) if max_file_bytes is None else F.coalesce(F.col("size") <= max_file_bytes, F.lit(False))
    if marked:
        counted = tree.withColumn("_counted", F.when(fits, F.col("size")).otherwise(0))
        summed = running_total(counted, ["repo_id"], "list_pos", "_counted", "bytes_so_far").drop("_counted")
    else:
        summed = running_total(tree.where(fits), ["repo_id"], "list_pos", "size", "bytes_so_far")
    if max_total is None:
        out = summed.withColumn("truncated", F.lit(False))
        return out.withColumn("kept", fits) if marked else out
    cut = (
        summed.groupBy("repo_id")
        .agg(F.bool_or(F.col("bytes_so_far") > max_total).alias("truncated"))
    )
    if marked:
        return summed.withColumn("kept", fits & (F.col("bytes_so_far") <= max_total)).join(cut, "repo_id")
    return summed.where(F.col("bytes_so_far") <= max_total).join(cut, "repo_id")


def explode_lines(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """(repo_id, path, line, text); ``keep`` drops whole files before they are split."""
    source = files.where(F.col("content").isNotNull())
    if keep is not None:
        source = source.where(keep)
    others = [c for c in files.columns if c != "content"]
    return source.select(
        *others, F.posexplode(X.lines_of(F.col("content"))).alias("pos", "text")
    ).select(*others, (F.col("pos") + 1).alias("line"), "text")


def with_language(tree: DataFrame) -> DataFrame:
    lang = P.language_of(F.col("path"))
    return tree.withColumn("language", lang).withColumn(
        "is_programming", P.is_programming_language(F.col("language"))
    )


def path_predicates(tree: DataFrame) -> DataFrame:
    p = F.col("path")
    return tree.select(
        "*",
        P.is_fixture(p).alias("is_fixture"),
        P.is_generated(p).alias("is_generated"),
        P.is_document(p).alias("is_document"),
        P.is_sample_material(p).alias("is_sample_material"),
        P.is_prose(p).alias("is_prose"),
        P.is_test_file(p).alias("is_test"),
        P.is_test_dir(p).alias("is_test_dir"),
        P.is_config(p).alias("is_config"),
        P.is_documentation(p).alias("is_documentation"),
        P.is_allowlisted_template(p).alias("is_template"),
    )
