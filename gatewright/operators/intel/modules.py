"""Module boundaries and module-level dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.functions.numbers import round4, saturating
from gatewright.operators.intel.manifests import module_dir
from gatewright.operators.scale import top_k
from gatewright.sources.tables import stored


def directories(text: DataFrame) -> DataFrame:
    return text.select("repo_id", F.explode(P.ancestor_dirs(F.col("path"))).alias("dir")).distinct()


def workspace_dirs(globs: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expand ``x``, ``x/*`` and ``x/**`` over directories: (matched dirs, unexpanded globs).

    Each directory lists the bases it would match under each form, so globbing
    is one equi-join.
    """
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.trim("glob"), F.lit("\\"), F.lit("/")), r"^\./", ""), r"/+\z", "")
    form = (
        F.when(clean.endswith("/**"), "deep")
        .when(clean.endswith("/*"), "child")
        .when(clean.contains("*") | clean.startswith("!"), "none")
        .otherwise("self")
    )
    wanted = (
        globs.where(clean != "")
        .select("repo_id", "glob", form.alias("form"), F.regexp_replace(clean, r"/\*{1,2}\z", "").alias("base"))
        .distinct()
    )
    d = F.col("dir")
    forms = F.concat(
        F.array(
            F.struct(F.lit("self").alias("form"), d.alias("base")),
            F.struct(F.lit("child").alias("form"), P.dirname(d).alias("base")),
        ),
        F.transform(
            F.concat(P.ancestor_dirs(d), F.array(d)), lambda a: F.struct(F.lit("deep").alias("form"), a.alias("base"))
        ),
    )
    offered = dirs.select("repo_id", "dir", F.explode(forms).alias("f")).select("repo_id", "dir", "f.form", "f.base")
    key = ["repo_id", "form", "base"]
    matched = offered.join(wanted, key).select("repo_id", "dir").distinct()
    unexpanded = wanted.join(offered.select(*key).distinct(), key, "left_anti").select("repo_id", "glob")
    return matched, unexpanded


def detect_modules(
    text: DataFrame, parsed: DataFrame, repos: DataFrame | None = None, min_files: int = D.MIN_MODULE_FILES,
    folder: str | None = None,
) -> DataFrame:
    """(repo_id, path, name, kind, rule) by five ordered rules; the first rule of a path wins.

    ``repos(repo_id, name)`` gives the root module its name.  With ``folder`` what later rules ask again about (the
    repositories' counts, the first rules' modules) is written there once.
    """
    by_dir = parsed.select("*", module_dir(F.col("path")).alias("dir"))
    owners = by_dir.groupBy("repo_id", "dir").agg(
        F.min_by(F.struct("path", "package_name"), F.struct("priority", "path")).alias("m")
    )
    named = owners.select(
        "repo_id",
        "dir",
        F.coalesce("m.package_name", P.basename(F.col("dir"))).alias("name"),
        F.col("m.path").alias("manifest"),
    )
    globs = parsed.select("repo_id", F.explode("globs").alias("glob"))
    matched, _ = workspace_dirs(globs, directories(text))
    r1 = matched.join(named, ["repo_id", "dir"]).select(
        "repo_id", F.col("dir").alias("path"), "name", F.lit("workspace-package").alias("kind"), F.lit(1).alias("rule")
    )

    p = F.col("path")
    tools = text.groupBy("repo_id").agg(
        F.bool_or(p.startswith("contracts/") & p.rlike(r"\.(sol|vy|cairo|move)\z")).alias("sources"),
        F.bool_or((p == "foundry.toml") | p.rlike(r"^hardhat\.config\.[cm]?[jt]s\z")).alias("tool"),
        F.count(F.lit(1)).alias("files"),
    )
    if repos is None:
        tools = tools.withColumn("root_name", F.lit("."))
    else:
        names = repos.select("repo_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit(".")).alias("root_name"))
        tools = tools.join(names, "repo_id", "left").fillna(".", ["root_name"])
    tools = stored(tools, folder, "module-tools")
    r2 = tools.where(F.col("sources") | F.col("tool")).select(
        "repo_id",
        F.when(F.col("sources"), "contracts").otherwise(".").alias("path"),
        F.when(F.col("sources"), F.lit("contracts")).otherwise(F.col("root_name")).alias("name"),
        F.lit("contract-package").alias("kind"),
        F.lit(2).alias("rule"),
    )
    root_workspace = (F.col("dir") == ".") & F.col("manifest").rlike(r"(^|/)pnpm-workspace\.ya?ml\z")
    r3 = named.where(~root_workspace).select(
        "repo_id", F.col("dir").alias("path"), "name", F.lit("package").alias("kind"), F.lit(3).alias("rule")
    )
    ahead = stored(r1.unionByName(r2).unionByName(r3), folder, "module-rules")
    covering = ahead.select("repo_id", F.substring_index("path", "/", 1).alias("path")).distinct()
    top = F.substring_index("path", "/", 1)
    r4 = (
        text.where(p.contains("/"))
        .groupBy("repo_id", top.alias("path"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_files)
        .join(covering, ["repo_id", "path"], "left_anti")
        .select(
            "repo_id", "path", F.col("path").alias("name"), F.lit("directory").alias("kind"), F.lit(4).alias("rule")
        )
    )
    found = ahead.unionByName(stored(r4, folder, "module-tops"))
    r5 = (
        tools.where(F.col("files") >= min_files)
        .join(found.select("repo_id").distinct(), "repo_id", "left_anti")
        .select(
            "repo_id",
            F.lit(".").alias("path"),
            F.col("root_name").alias("name"),
            F.lit("directory").alias("kind"),
            F.lit(5).alias("rule"),
        )
    )
    best = F.min_by(F.struct("name", "kind", "rule"), "rule")
    return found.unionByName(r5).groupBy("repo_id", "path").agg(best.alias("m")).select("repo_id", "path", "m.*")


def module_files(text: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, module, path, size): containment by exploded ancestors, an equi-join."""
    holders = F.concat(F.array(F.lit(".")), P.ancestor_dirs(F.col("path")))
    rows = text.select("repo_id", "path", "size", F.explode(holders).alias("module"))
    keys = modules.select("repo_id", F.col("path").alias("module"))
    return rows.join(keys, ["repo_id", "module"], "left_semi")


def module_dependencies(modules: DataFrame, parsed: DataFrame) -> DataFrame:
    """(repo_id, module, depends_on): declared dependencies that name another module.

    A module reads the manifests of its own directory, or else those below it.
    """
    deps = parsed.select("repo_id", "path", module_dir(F.col("path")).alias("dir"), F.explode("deps").alias("d"))
    deps = deps.select("repo_id", "dir", F.col("d.name").alias("dep")).distinct()
    has_own = parsed.select("repo_id", module_dir(F.col("path")).alias("path")).distinct()
    own = modules.join(has_own, ["repo_id", "path"], "left_semi").select("repo_id", F.col("path").alias("module"), "name")
    bare = (
        modules.where(F.col("path") != ".")
        .join(has_own, ["repo_id", "path"], "left_anti")
        .select("repo_id", F.col("path").alias("module"), "name")
    )
    direct = own.join(deps.withColumnRenamed("dir", "module"), ["repo_id", "module"])
    lifted = deps.select(
        "repo_id", "dep", F.explode(F.concat(P.ancestor_dirs(F.col("dir")), F.array("dir"))).alias("module")
    ).distinct()
    below = bare.join(lifted, ["repo_id", "module"])
    wanted = direct.unionByName(below.select(*direct.columns)).where(F.col("dep") != F.col("name"))
    names = modules.select("repo_id", F.col("name").alias("dep")).distinct()
    return (
        wanted.join(names, ["repo_id", "dep"], "left_semi")
        .select("repo_id", "module", F.col("dep").alias("depends_on"))
        .distinct()
    )


def module_importance(
    modules: DataFrame,
    contained: DataFrame,
    edges: DataFrame,
    entry: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """Importance from fan-in, size and entrypoints; ranked per repository; with ``limit`` the first modules."""
    fan_in = edges.groupBy("repo_id", F.col("depends_on").alias("name")).agg(F.count(F.lit(1)).alias("fan_in"))
    lang = P.language_of(F.col("path"))
    sizes = contained.groupBy("repo_id", "module").agg(
        F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_set(lang)).alias("languages")
    )
    holders = F.concat(F.array(F.lit("."), F.col("path")), P.ancestor_dirs(F.col("path")))
    entered = entry.select("repo_id", F.explode(holders).alias("module")).distinct().withColumn("entered", F.lit(1.0))
    rows = (
        modules.withColumn("module", F.col("path"))
        .join(sizes, ["repo_id", "module"], "left")
        .join(entered, ["repo_id", "module"], "left")
        .join(fan_in, ["repo_id", "name"], "left")
        .fillna(0, ["fan_in", "file_count"])
        .fillna(0.0, ["entered"])
    )
    score = round4(
        F.lit(0.5) * saturating(F.col("fan_in"), 3.0)
        + F.lit(0.3) * saturating(F.col("file_count"), 20.0)
        + F.lit(0.2) * F.col("entered")
    )
    scored = rows.select("repo_id", "path", "name", "kind", "fan_in", "file_count", "languages", score.alias("importance"))
    return top_k(scored, ["repo_id"], [F.col("importance").desc(), F.col("path")], limit)
