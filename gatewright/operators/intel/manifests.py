"""Dependency manifests: names, dependencies, workspace globs, package managers.

Manifests are a sliver of any corpus, so they are filtered by name before
anything is split.  JSON is read with the variant functions; line formats become
lines with their section carried down by a window over one manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.functions import text as X
from gatewright.operators.scale import top_k
from gatewright.sources.tables import stored

# Manifest kinds by path.
MANIFEST_KINDS = {
    "package_json": r"(^|/)package\.json\z",
    "cargo": r"(^|/)Cargo\.toml\z",
    "go_mod": r"(^|/)go\.mod\z",
    "pyproject": r"(^|/)pyproject\.toml\z",
    "requirements": r"(^|/)requirements[^/]*\.txt\z",
    "pnpm_workspace": r"(^|/)pnpm-workspace\.ya?ml\z",
}
UNPARSED = (
    r"(^|/)(Gemfile|composer\.json|pubspec\.yaml|pom\.xml|build\.gradle(\.kts)?|mix\.exs|[^/]+\.csproj"
    r"|Package\.swift|shard\.yml|Project\.toml|CMakeLists\.txt|Package\.json)\z"
)
PACKAGE_SECTIONS = {
    "dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer",
    "optionalDependencies": "optional",
}
MANAGER_PATHS = {
    "pnpm": r"(^|/)pnpm-lock\.yaml\z",
    "npm": r"(^|/)package-lock\.json\z",
    "yarn": r"(^|/)yarn\.lock\z",
    "bun": r"(^|/)bun\.lockb?\z",
    "poetry": r"(^|/)poetry\.lock\z",
    "uv": r"(^|/)uv\.lock\z",
    "pipenv": r"(^|/)(Pipfile\.lock|Pipfile)\z",
    "cargo": r"(^|/)Cargo\.(lock|toml)\z",
    "go": r"(^|/)go\.(sum|mod)\z",
    "foundry": r"(^|/)foundry\.toml\z",
    "composer": r"(^|/)composer\.lock\z",
    "bundler": r"(^|/)Gemfile\.lock\z",
    "pip": r"(^|/)requirements[^/]*\.txt\z",
}
DEPENDENCY = "array<struct<name:string,version:string,kind:string>>"


def manifest_kind(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(rx), F.lit(k)) for k, rx in MANIFEST_KINDS.items()])


def manifests(files: DataFrame) -> DataFrame:
    """Readable manifests with their kind and its priority."""
    kind = manifest_kind(F.col("path"))
    order = F.array(*[F.lit(k) for k in MANIFEST_KINDS])
    return (
        files.where(F.col("content").isNotNull() & F.col("path").rlike("|".join(MANIFEST_KINDS.values())))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("priority", F.array_position(order, F.col("kind")))
    )


# --- package.json --------------------------------------------------------------------
def _package_json(rows: DataFrame) -> DataFrame:
    doc = rows.where(F.col("kind") == "package_json").withColumn("doc", F.try_parse_json("content"))

    def table(section: str, kind: str) -> Column:
        def row(e: Column) -> Column:
            text = F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string"))
            return F.struct(e["key"].alias("name"), text.alias("version"), F.lit(kind).alias("kind"))

        entries = F.map_entries(F.try_variant_get("doc", f"$.{section}", "map<string,variant>"))
        return F.coalesce(F.transform(entries, row).cast(DEPENDENCY), F.array().cast(DEPENDENCY))

    tables = [table(section, kind) for section, kind in PACKAGE_SECTIONS.items()]
    globs = F.coalesce(
        F.try_variant_get("doc", "$.workspaces", "array<string>"),
        F.try_variant_get("doc", "$.workspaces.packages", "array<string>"),
        F.array().cast("array<string>"),
    )
    note = F.when(F.col("doc").isNull(), F.array(F.concat(F.lit("Could not parse "), F.col("path"))))
    return doc.select(
        "repo_id",
        "path",
        "priority",
        F.try_variant_get("doc", "$.name", "string").alias("package_name"),
        globs.alias("globs"),
        F.concat(*tables).cast(DEPENDENCY).alias("deps"),
        F.coalesce(note, F.array().cast("array<string>")).alias("notes"),
    )


# --- line formats --------------------------------------------------------------------
def _requirement(spec: Column) -> Column:
    """struct(name, version) of a requirement line; null when it is a URL, a path or unreadable."""
    bare = F.regexp_replace(F.trim(spec), "\\A[\"']|[\"']\\z", "")
    pattern = r"\A([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)\z"
    rest = F.regexp_replace(F.substring_index(F.regexp_extract(bare, pattern, 2), ";", 1), r"\s+", "")
    usable = (bare != "") & ~bare.rlike(r"(?i)^(https?:|git\+|git:|file:|\.{0,2}/)") & bare.rlike(pattern)
    return F.when(
        usable,
        F.struct(F.regexp_extract(bare, pattern, 1).alias("name"), F.nullif(rest, F.lit("")).alias("version")),
    )


def _toml_string(value: Column) -> Column:
    double = F.regexp_extract(value, r'\A"((?:[^"\\]|\\.)*)"\z', 1)
    single = F.regexp_extract(value, r"\A'([^']*)'\z", 1)
    return F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")))


def _toml_version(value: Column) -> Column:
    inline = F.regexp_extract(value, r"""\A\{(?:.*,)?\s*version\s*=\s*["']([^"']*)["'].*\}\z""", 1)
    return F.coalesce(_toml_string(value), F.nullif(inline, F.lit("")))


def _items(body: Column) -> Column:
    """Items of an inline array: split on commas outside quotes and brackets."""
    parts = F.split(body, r""",(?=(?:[^"]*"[^"]*")*[^"]*\z)(?![^\[]*\])(?![^{]*\})""")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def _toml_entries(rows: DataFrame) -> DataFrame:
    """(manifest, line, section, key, value) with multi-line arrays joined to one value.

    A line opens an array when its value starts with ``[`` and has no ``]``; it
    runs to the next line with ``]``.  Lines inside are given their opener's
    number by a running window over the manifest and then joined.
    """
    strip = r"""\A((?:[^"'#]|"[^"]*"|'[^']*')*)#.*\z"""
    key = ["repo_id", "path"]
    lines = rows.select(*key, "kind", F.posexplode(X.lines_of(F.col("content"))).alias("line", "raw"))
    lines = lines.withColumn("text", F.trim(F.regexp_replace("raw", strip, "$1"))).where(F.col("text") != "")
    text = F.col("text")
    w = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opens = text.rlike(r'^([A-Za-z0-9_.-]+|"[^"]+")\s*=\s*\[') & ~text.contains("]")
    state = F.when(opens, F.lit("open")).when(text.contains("]"), F.lit("close"))
    inside = F.last(state, ignorenulls=True).over(before) == "open"
    marked = lines.withColumn("inside", F.coalesce(inside, F.lit(False)))
    header = F.when(~F.col("inside"), F.nullif(F.regexp_extract("text", r"^\[([^\]]+)\]\z", 1), F.lit("")))
    owner = F.when(~F.col("inside"), F.col("line"))
    marked = marked.withColumn("section", F.coalesce(F.last(F.trim(header), ignorenulls=True).over(w), F.lit("")))
    marked = marked.withColumn("entry", F.last(owner, ignorenulls=True).over(w))
    joined = marked.groupBy(*key, "kind", "entry").agg(
        F.min("section").alias("section"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " "
        ).alias("text"),
    )
    pair = r'\A([A-Za-z0-9_.-]+|"[^"]+")\s*=\s*(.*)\z'
    return (
        joined.where(F.col("text").rlike(pair))
        .withColumn("key", F.replace(F.regexp_extract("text", pair, 1), F.lit('"'), F.lit("")))
        .withColumn("value", F.trim(F.regexp_extract("text", pair, 2)))
        .drop("text")
    )


def _python_kind(section: Column, key: Column) -> Column:
    return (
        F.when((section == "project") & (key == "dependencies"), "runtime")
        .when(section == "project.optional-dependencies", "optional")
        .when((section == "build-system") & (key == "requires"), "dev")
        .when(section == "tool.poetry.dependencies", "runtime")
        .when(section == "tool.poetry.dev-dependencies", "dev")
        .when(section.rlike(r"^tool\.poetry\.group\.[^.]+\.dependencies\z"), "dev")
    )


def _cargo_kind(section: Column) -> Column:
    return (
        F.when(section == "dependencies", "runtime")
        .when(section.isin("dev-dependencies", "build-dependencies"), "dev")
        .when(section.rlike(r"^target\..*\.dependencies\z"), "runtime")
        .when(section.rlike(r"^target\..*\.dev-dependencies\z"), "dev")
    )


def _toml(rows: DataFrame) -> DataFrame:
    entries = _toml_entries(rows.where(F.col("kind").isin("pyproject", "cargo")))
    section, key, value = F.col("section"), F.col("key"), F.col("value")
    python = F.col("kind") == "pyproject"
    dep_kind = F.when(python, _python_kind(section, key)).otherwise(_cargo_kind(section))
    listed = value.startswith("[")
    items = _items(F.regexp_replace(value, r"\A\[|\]\z", ""))
    requirements = F.filter(
        F.transform(items, _requirement), lambda r: r.isNotNull() & (F.lower(r["name"]) != "python")
    )
    table_item = F.struct(key.alias("name"), _toml_version(value).alias("version"), dep_kind.alias("kind"))
    deps = F.when(
        python & listed & dep_kind.isNotNull(),
        F.transform(
            requirements, lambda r: F.struct(r["name"].alias("name"), r["version"].alias("version"), dep_kind.alias("kind"))
        ),
    ).when(~(python & listed) & dep_kind.isNotNull(), F.array(table_item))
    names = F.when(
        (python & (section == "project") & (key == "name")) | (~python & (section == "package") & (key == "name")),
        _toml_string(value),
    )
    globs = F.when(
        ~python & (section == "workspace") & (key == "members"),
        F.transform(items, lambda s: F.regexp_replace(s, "\\A[\"']|[\"']\\z", "")),
    )
    empty_deps, empty_globs = F.array().cast(DEPENDENCY), F.array().cast("array<string>")
    return (
        entries.select(
            "repo_id", "path", "entry", names.alias("n"), F.coalesce(deps.cast(DEPENDENCY), empty_deps).alias("d"),
            F.coalesce(globs, empty_globs).alias("g"),
        )
        .groupBy("repo_id", "path")
        .agg(
            F.max("n").alias("package_name"),
            F.flatten(
                F.transform(F.array_sort(F.collect_list(F.struct("entry", "g"))), lambda s: s["g"])
            ).alias("globs"),
            F.flatten(
                F.transform(F.array_sort(F.collect_list(F.struct("entry", "d"))), lambda s: s["d"])
            ).alias("deps"),
        )
    )


def _lines(rows: DataFrame) -> DataFrame:
    """requirements.txt and pnpm workspaces: no nesting, so arrays inside the row are enough."""
    lines = F.transform(X.lines_of(F.col("content")), lambda l: F.trim(l))
    reqs = F.filter(lines, lambda l: (l != "") & ~l.startswith("#") & ~l.startswith("-"))
    parsed = F.transform(reqs, lambda l: _requirement(F.regexp_replace(l, r"\s+#.*\z", "")))
    deps = F.transform(
        F.filter(parsed, lambda r: r.isNotNull()),
        lambda r: F.struct(r["name"].alias("name"), r["version"].alias("version"), F.lit("runtime").alias("kind")),
    )
    options = F.transform(
        F.filter(lines, lambda l: l.startswith("-")), lambda l: F.concat(F.lit("Skipped an option line: "), l)
    )
    block = F.regexp_extract("content", r"(?m)^packages\s*:([^\n]*(?:\r?\n(?:[ \t-][^\n]*|))*)", 1)
    entries = F.transform(F.split(block, X.LINE_BREAK), lambda l: F.trim(F.regexp_replace(l, r"\s+#.*\z", "")))
    dashes = F.transform(
        F.filter(entries, lambda l: l.startswith("-")),
        lambda l: F.regexp_replace(F.regexp_replace(l, r"\A-\s*", ""), "\\A[\"']|[\"']\\z", ""),
    )
    inline = F.transform(
        F.split(F.regexp_extract(block, r"\A\s*\[([^\]]*)\]", 1), ","),
        lambda s: F.regexp_replace(F.trim(s), "\\A[\"']|[\"']\\z", ""),
    )
    globs = F.filter(F.concat(inline, dashes), lambda g: g != "")
    is_req = F.col("kind") == "requirements"
    empty = F.array().cast("array<string>")
    return rows.where(F.col("kind").isin("requirements", "pnpm_workspace")).select(
        "repo_id",
        "path",
        "priority",
        F.lit(None).cast("string").alias("package_name"),
        F.when(is_req, empty).otherwise(globs).alias("globs"),
        F.when(is_req, deps.cast(DEPENDENCY)).otherwise(F.array().cast(DEPENDENCY)).alias("deps"),
        F.when(is_req, options).otherwise(empty).alias("notes"),
    )


def _go(rows: DataFrame) -> DataFrame:
    """go.mod: single requires, and the lines between ``require (`` and ``)``."""
    body = F.regexp_replace("content", r"//[^\n]*", "")
    blocks = F.regexp_extract_all(body, F.lit(r"(?m)^\s*require\s*\(([^)]*)\)"), F.lit(1))
    inner = F.flatten(F.transform(blocks, lambda b: F.split(b, X.LINE_BREAK)))
    single = F.regexp_extract_all(body, F.lit(r"(?m)^\s*require\s+([^\s(][^\n]*)"), F.lit(1))
    specs = F.filter(F.transform(F.concat(inner, single), lambda s: F.trim(s)), lambda s: s != "")
    deps = F.transform(
        specs,
        lambda s: F.struct(
            F.substring_index(F.regexp_replace(s, r"\s+", " "), " ", 1).alias("name"),
            F.nullif(F.regexp_extract(s, r"\A\S+\s+(\S+)", 1), F.lit("")).alias("version"),
            F.lit("runtime").alias("kind"),
        ),
    )
    name = F.regexp_extract(body, r'(?m)^\s*module\s+"?([^\s"]+)', 1)
    notes = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?m)^\s*(replace|exclude)\s"), F.lit(1)),
        lambda d: F.concat(d, F.lit(" directives are not applied")),
    )
    return rows.where(F.col("kind") == "go_mod").select(
        "repo_id",
        "path",
        "priority",
        F.nullif(name, F.lit("")).alias("package_name"),
        F.array().cast("array<string>").alias("globs"),
        deps.cast(DEPENDENCY).alias("deps"),
        notes.alias("notes"),
    )


def parse_manifests(files: DataFrame, max_notes: int | None = None, folder: str | None = None) -> DataFrame:
    """(repo_id, path, priority, package_name, globs, deps, notes), one row per manifest.

    With ``folder`` the manifests, which every format's parser reads, are written there once.
    """
    rows = stored(manifests(files), folder, "manifest-files")
    head = rows.where(F.col("kind").isin("pyproject", "cargo")).select("repo_id", "path", "priority")
    toml = head.join(_toml(rows), ["repo_id", "path"], "left").select(
        "repo_id", "path", "priority", "package_name",
        F.coalesce("globs", F.array().cast("array<string>")).alias("globs"),
        F.coalesce("deps", F.array().cast(DEPENDENCY)).alias("deps"),
        F.array().cast("array<string>").alias("notes"),
    )
    parsed = _package_json(rows).unionByName(toml).unionByName(_lines(rows)).unionByName(_go(rows))
    return parsed if max_notes is None else parsed.withColumn("notes", F.slice("notes", 1, max_notes))


def manifest_dependencies(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", F.col("path").alias("manifest"), F.posexplode("deps").alias("nth", "d")).select(
        "repo_id", "manifest", "nth", "d.*"
    )


def external_dependencies(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    """First per (manifest, kind, name), ranked by manifest, name, kind; with ``limit`` the first per repository."""
    keys = ["repo_id", "manifest", "kind", "name"]
    first = manifest_dependencies(parsed).groupBy(*keys).agg(F.min_by("version", "nth").alias("version"))
    return top_k(first, ["repo_id"], [F.col("manifest"), F.col("name"), F.col("kind")], limit)


def unparsed_manifests(text: DataFrame) -> DataFrame:
    return text.where(F.col("path").rlike(UNPARSED)).select("repo_id", "path")


def package_managers(listing: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Distinct (repo_id, manager) from the lockfiles and manifests of an admitted listing, and from declared fields.

    The fields are read from ``files(repo_id, path, content)``, or from the listing's own contents; what they declare,
    not the files, meets the listing.
    """
    p, body = F.col("path"), F.col("content")
    source = listing if files is None else files
    declared = F.when(
        p.rlike(MANIFEST_KINDS["package_json"]),
        F.nullif(
            F.trim(F.substring_index(F.try_variant_get(F.try_parse_json(body), "$.packageManager", "string"), "@", 1)),
            F.lit(""),
        ),
    )
    poetry = F.when(
        p.rlike(MANIFEST_KINDS["pyproject"]) & body.rlike(r"(?m)^\s*\[tool\.poetry\]"), F.lit("poetry")
    )
    likely = source.where(p.rlike(MANIFEST_KINDS["package_json"]) | p.rlike(MANIFEST_KINDS["pyproject"]))
    said = likely.select("repo_id", "path", F.coalesce(declared, poetry).alias("manager")).where(F.col("manager").isNotNull())
    said = said.join(listing.select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "manager")
    seen = F.array_compact(F.array(*[F.when(p.rlike(rx), F.lit(name)) for name, rx in MANAGER_PATHS.items()]))
    return listing.select("repo_id", F.explode(seen).alias("manager")).unionByName(said).distinct()


def module_dir(path: Column) -> Column:
    directory = P.dirname(path)
    return F.when(directory == "", F.lit(".")).otherwise(directory)
