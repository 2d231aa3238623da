"""Import statements per language, and what they resolve to."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import ascii_boundaries
from gatewright.functions import paths as P
from gatewright.functions import text as X

# Per language (pattern on the trimmed line, prefix for non-relative specifiers).
LINE_RULES = {
    "Solidity": [(ascii_boundaries(r"^import\b[^\"']*[\"']([^\"']+)[\"']"), "")],
    "Go": [(r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', "")],
    "Rust": [
        (r"^use\s+([\w:]+)", ""),
        (r"^pub\s+use\s+([\w:]+)", ""),
        (r"^(?:pub\s+)?mod\s+([A-Za-z_]\w*)\s*;", "self::"),
        (r"^extern\s+crate\s+([A-Za-z_]\w*)", ""),
    ],
    "Java": [(r"^import\s+(?:static\s+)?([\w.]+)", "")],
    "Kotlin": [(r"^import\s+([\w.]+)", "")],
    "Ruby": [
        (r"^require_relative\s+['\"]([^'\"]+)['\"]", "./"),
        (r"^require\s+['\"]([^'\"]+)['\"]", ""),
        (r"^load\s+['\"]([^'\"]+)['\"]", "./"),
    ],
    "Shell": [(r"^(?:\.|source)\s+(\S+)", "")],
    "Protobuf": [(r"^import\s+(?:public\s+|weak\s+)?[\"']([^\"']+)[\"']", "")],
    "GraphQL": [(r"^#import\s+[\"']([^\"']+)[\"']", "")],
}
SCRIPT_LANGUAGES = ["TypeScript", "JavaScript"]
SCRIPT_IMPORT = ascii_boundaries(r"(?:\bfrom|\bimport|\brequire)\s*\(?\s*[\"']([^\"']+)[\"']")
# Lines are told by \n alone, so a blank before the bracket is any white space but that.
GO_OPEN, GO_CLOSE, GO_INNER = r"(?md)^import[^\S\n]*\(", r"(?md)^[^\S\n]*\)", r'(?:[\w.]+\s+)?"([^"]+)"'
PY_FROM = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]*)"
PY_IMPORT = r"^import\s+(.+)\z"

# Words of which every line with an import of the language holds one.
LINE_WORDS = {
    "TypeScript": ["from", "import", "require"], "JavaScript": ["from", "import", "require"], "Python": ["import"], "Java": ["import"],
    "Go": ["import"], "Rust": ["use", "mod", "crate"], "Solidity": ["import"], "Ruby": ["require", "load"], "Kotlin": ["import"],
    "Shell": [".", "source"], "Protobuf": ["import"], "GraphQL": ["import"],
}
IMPORT_LANGUAGES = [*SCRIPT_LANGUAGES, "Python", *LINE_RULES]
EXTENSIONS = {
    "TypeScript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"],
    "JavaScript": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"],
    "Solidity": [".sol"],
    "Ruby": [".rb"],
    "Shell": [".sh", ".bash"],
    "Protobuf": [".proto"],
    "GraphQL": [".graphql", ".gql"],
    "Java": [".java"],
    "Kotlin": [".kt", ".kts"],
    "Rust": [".rs"],
}
REWRITES = {
    ".js": [".ts", ".tsx", ".js", ".jsx"],
    ".jsx": [".tsx", ".jsx"],
    ".mjs": [".mts", ".mjs"],
    ".cjs": [".cts", ".cjs"],
}
INDEX_NAMES = ["index", "mod", "__init__", "main"]
SOURCE_ROOTS = {
    "Java": ["", "src/main/java/", "src/test/java/", "src/", "app/src/main/java/"],
    "Kotlin": ["", "src/main/kotlin/", "src/test/kotlin/", "src/", "app/src/main/kotlin/"],
}
assert set(LINE_WORDS) == set(IMPORT_LANGUAGES)
_RECORDS = "array<struct<raw:string,specifier:string,certain:boolean>>"
_PLACED = "array<struct<line:int,nth:int,raw:string,specifier:string,certain:boolean>>"


def _import_sources(files: DataFrame) -> DataFrame:
    return (
        files.where(F.col("content").isNotNull())
        .withColumn("language", P.language_of(F.col("path")))
        .where(F.col("language").isin(*IMPORT_LANGUAGES))
        .select("repo_id", "path", "language", "content")
    )


def _record(raw: Column, specifier: Column, certain: bool = True) -> Column:
    return F.struct(raw.alias("raw"), specifier.alias("specifier"), F.lit(certain).alias("certain"))


def _at(line: Column, records: Column) -> Column:
    """Records with their line and their place among those of the line."""
    return F.transform(records, lambda r, n: F.struct(line.cast("int").alias("line"), n.cast("int").alias("nth"), r["raw"].alias("raw"), r["specifier"].alias("specifier"), r["certain"].alias("certain")))


def _line_records(text: Column, lang: Column) -> Column:
    """Records of one trimmed line: the first rule of the language that matches wins.

    The language is told once, and a line without a word of its import statements meets no rule.
    """
    said: dict[str, Column] = {}
    for language, rules in LINE_RULES.items():
        options = []
        for pattern, prefix in rules:
            found = F.regexp_extract(text, pattern, 1)
            relative = found.startswith(".") | found.startswith("/")
            applied = F.when(relative, found).otherwise(F.concat(F.lit(prefix), found)) if prefix else found
            options.append(F.when(text.rlike(pattern), F.array(_record(found, applied))))
        said[language] = F.coalesce(*options)
    scripts = F.transform(F.regexp_extract_all(text, F.lit(SCRIPT_IMPORT), F.lit(1)), lambda s: _record(s, s))
    comment = text.startswith("//") | text.startswith("*") | text.startswith("/*")
    for language in SCRIPT_LANGUAGES:
        said[language] = F.when(~comment, scripts)
    names = F.transform(
        F.split(F.regexp_extract(text, PY_IMPORT, 1), ","), lambda s: F.trim(F.regexp_replace(F.trim(s), r"\s+as\s+.*\z", ""))
    )
    names = F.filter(names, lambda s: s != "")
    said["Python"] = F.when(text.rlike(PY_IMPORT), F.transform(names, lambda s: _record(s, s)))
    told = F
    for language, words in LINE_WORDS.items():
        worded = reduce(Column.__or__, [text.contains(word) for word in words])
        told = told.when(lang == language, F.when(worded, said[language]))
    return F.coalesce(told, F.array().cast(_RECORDS))


def _go_records(body: Column) -> Column:
    """Specifiers inside ``import ( ... )``: from the line after the opening one up to the first that closes.

    Cutting the text at the opening lines leaves pieces that begin inside a block; `match_lines` counts their lines.
    """
    starts = X.match_lines(body, GO_OPEN)
    blocks = F.zip_with(
        F.slice(F.split(body, GO_OPEN, -1), F.lit(2), F.greatest(F.size(starts), F.lit(0))),
        starts,
        lambda piece, at: F.struct(F.split(F.element_at(F.split(piece, GO_CLOSE, 2), 1), r"\r?\n").alias("lines"), at["line"].alias("line")),
    )

    def inner(block: Column) -> Column:
        def of_line(text: Column, n: Column) -> Column:
            found = F.regexp_extract(text, GO_INNER, 1)
            return _at(block["line"] + n, F.when((n > 0) & text.rlike(GO_INNER), F.array(_record(found, found))).otherwise(F.array().cast(_RECORDS)))

        return F.flatten(F.transform(block["lines"], of_line))

    return F.flatten(F.transform(blocks, inner))


def _python_records(body: Column) -> Column:
    """``from m import a, b``: the module itself, and each name as an uncertain submodule."""
    modules = F.regexp_extract_all(body, F.lit(PY_FROM), F.lit(1))
    lists = F.regexp_extract_all(body, F.lit(PY_FROM), F.lit(2))

    def of_match(at: Column, said: Column) -> Column:
        m = said["m"]
        names = F.filter(
            F.transform(
                F.split(F.regexp_replace(said["names"], "[()\r\n]", " "), ","),
                lambda s: F.trim(F.regexp_replace(F.trim(s), r"\s+as\s+.*\z", "")),
            ),
            lambda s: s != "",
        )
        dot = F.when(m.endswith("."), F.lit("")).otherwise(F.lit("."))
        records = F.concat(F.array(_record(m, m)), F.transform(names, lambda n: _record(F.concat_ws(" ", m, n), F.concat(m, dot, n), False)))
        return _at(at["line"], records)

    return F.flatten(F.zip_with(X.match_lines(body, PY_FROM), F.arrays_zip(modules.alias("m"), lists.alias("names")), of_match))


def extract_imports(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Import records, numbered per file in (line, specifier) order; with ``limit`` the first of them.

    A file stays one row until all its records are found, sorted and numbered: one scan and no shuffle.
    """
    body, lang = F.col("content"), F.col("language")
    by_line = F.flatten(F.transform(X.lines_of(body), lambda text, n: _at(n + 1, _line_records(F.trim(text), lang))))
    none = F.array().cast(_PLACED)
    records = F.concat(
        by_line,
        F.when((lang == "Go") & body.rlike(GO_OPEN), _go_records(body)).otherwise(none),
        F.when((lang == "Python") & body.rlike(PY_FROM), _python_records(body)).otherwise(none),
    )
    ordered = F.array_sort(F.transform(records, lambda r: F.struct(r["line"].alias("line"), r["specifier"].alias("specifier"), r["nth"].alias("nth"), r["raw"].alias("raw"), r["certain"].alias("certain"))))
    kept = ordered if limit is None else F.slice(ordered, F.lit(1), F.lit(limit))
    rows = _import_sources(files).select("repo_id", "path", "language", F.posexplode(kept).alias("at", "r"))
    return rows.select("repo_id", "path", "language", "r.line", "r.raw", "r.specifier", "r.certain", (F.col("at") + 1).alias("n"))


# --- resolution --------------------------------------------------------------------
def is_relative(spec: Column) -> Column:
    return spec.isin(".", "..") | spec.startswith("./") | spec.startswith("../")


_EMPTY = "array<string>"


def _extensions() -> Column:
    table = F.from_json(F.lit(json.dumps(EXTENSIONS)), "map<string,array<string>>")
    return F.coalesce(F.element_at(table, F.col("language")), F.array().cast(_EMPTY))


def _with_extensions(base: Column) -> Column:
    """The path itself, its source rewrites (script languages), then every extension."""
    suffix = F.regexp_extract(base, r"(\.(?:js|jsx|mjs|cjs))\z", 1)
    table = F.from_json(F.lit(json.dumps(REWRITES)), "map<string,array<string>>")
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(suffix))
    rewritten = F.when(
        F.col("language").isin(*SCRIPT_LANGUAGES),
        F.transform(F.element_at(table, suffix), lambda e: F.concat(stem, e)),
    )
    return F.concat(
        F.array(base),
        F.coalesce(rewritten, F.array().cast(_EMPTY)),
        F.transform(_extensions(), lambda e: F.concat(base, e)),
    )


def _relative_candidates(base: Column) -> Column:
    index = F.transform(_extensions(), lambda e: F.concat(base, F.lit("/index"), e))
    return F.concat(_with_extensions(base), index)


def _entry_candidates(directory: Column) -> Column:
    names = F.array(*[F.concat(directory, F.lit("/" + n)) for n in [*INDEX_NAMES, "src/index"]])
    return F.flatten(F.transform(names, _with_extensions))


def _absolute_candidates(path: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(SOURCE_ROOTS)), "map<string,array<string>>")
    roots = F.element_at(table, F.col("language"))
    return F.flatten(F.transform(roots, lambda r: _with_extensions(F.concat(r, path))))


def _dots(spec: Column) -> Column:
    return F.length(F.regexp_extract(spec, r"^(\.*)", 1))


def _python_base(spec: Column) -> Column:
    dots = _dots(spec)
    parts = F.split(F.col("path"), "/")
    # n dots climb n-1 directories above the file's own.
    depth = F.size(parts) - dots
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(depth, F.lit(0))), "/")
    rest = F.replace(F.substring(spec, dots + 1, F.length(spec)), F.lit("."), F.lit("/"))
    joined = P.normalise_path(F.concat_ws("/", base, rest))
    return F.when(dots == 0, F.replace(spec, F.lit("."), F.lit("/"))).when(depth >= 0, joined)


def _python_candidates(spec: Column, base: Column) -> Column:
    forms = lambda p: [F.concat(p, F.lit(e)) for e in (".py", ".pyi", "/__init__.py")]
    return F.when(_dots(spec) == 0, F.array(*forms(base), *forms(F.concat(F.lit("src/"), base)))).otherwise(F.array(*forms(base)))


def _rust_base(spec: Column) -> Column:
    clean = F.regexp_replace(spec, r"^::", "")
    in_crate = clean.startswith("crate::") | (clean == "crate")
    crate = F.concat(F.lit("src/"), F.replace(F.substring(clean, F.lit(8), F.length(clean)), F.lit("::"), F.lit("/")))
    directory, base = P.dirname(F.col("path")), P.basename(F.col("path"))
    own = F.when(base.isin("lib.rs", "main.rs", "mod.rs"), directory).otherwise(
        F.regexp_replace(F.col("path"), r"\.rs\z", "")
    )
    supers = F.regexp_extract(clean, r"^((?:super::)*)", 1)
    climb = F.concat(own, F.repeat(F.lit("/.."), (F.length(supers) / 7).cast("int")))
    rest = F.replace(
        F.regexp_replace(F.substring(clean, F.length(supers) + 1, F.length(clean)), r"^self::", ""), F.lit("::"), F.lit("/")
    )
    local = P.normalise_path(F.concat_ws("/", climb, rest))
    return F.when(in_crate, crate).when(clean.startswith("self::") | clean.startswith("super::"), local)


def _rust_candidates(base: Column) -> Column:
    return F.concat(F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs"))), _with_extensions(base))


def _own_directories(found: DataFrame, tree: DataFrame, modules: DataFrame | None, root_prefixes: DataFrame | None) -> DataFrame:
    """Adds ``named_dir``, the directory of the module that a specifier's package names, ``stripped``, what it has
    behind the longest root prefix that it starts with, and whether the tree has these directories.

    Every distinct specifier of a repository asks for its package and for each of its own leading paths; the answers
    meet them in one equi-join on (repo, key), so no repository's list is gathered, and come back to the imports by
    (repo, specifier).
    """
    known = []
    if modules is not None:
        named = modules.groupBy("repo_id", "name").agg(F.min("path").alias("answer"))
        known.append(named.select("repo_id", F.lit("module").alias("what"), F.col("name").alias("key"), "answer"))
    if root_prefixes is not None:
        clean = F.regexp_replace("prefix", r"/+\z", "")
        prefixes = root_prefixes.select("repo_id", clean.alias("key")).where("key <> ''").distinct()
        known.append(prefixes.select("repo_id", F.lit("prefix").alias("what"), "key", F.col("key").alias("answer")))
    if not known:
        return found.withColumns({n: F.lit(None).cast("string") for n in ("named_dir", "stripped")} | {n: F.lit(None).cast("boolean") for n in ("named_there", "stripped_there")})
    spec = F.col("spec")
    bare = ~spec.startswith(".") & ~spec.startswith("/")
    asks = F.concat(
        F.array(F.struct(F.lit("module").alias("what"), F.when(bare, P.package_name_of(spec)).alias("key"))),
        F.transform(P.ancestor_dirs(spec), lambda d: F.struct(F.lit("prefix").alias("what"), d.alias("key"))),
    )
    asked = found.select("repo_id", "spec").distinct().select("repo_id", "spec", F.inline(asks)).where("key IS NOT NULL")
    answers = known[0] if len(known) == 1 else known[0].unionByName(known[1])
    longest = F.max(F.when(F.col("what") == "prefix", F.struct(F.length("answer").alias("size"), F.col("answer"))))
    told = asked.join(answers, ["repo_id", "what", "key"]).groupBy("repo_id", "spec").agg(
        F.max(F.when(F.col("what") == "module", F.col("answer"))).alias("named_dir"), longest["answer"].alias("prefix")
    )
    rest = F.substring(spec, F.length("prefix") + 2, F.length(spec))
    told = told.withColumn("stripped", F.when(F.col("prefix").isNotNull(), P.normalise_path(rest)))
    dirs = tree.select("repo_id", F.explode(P.ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    for name in ("named_dir", "stripped"):
        there = dirs.select("repo_id", F.col("dir").alias(name), F.lit(True).alias(f"{name.removesuffix('_dir')}_there"))
        told = told.join(there, ["repo_id", name], "left")
    return found.join(told, ["repo_id", "spec"], "left").select(*found.columns, "named_dir", "stripped", "named_there", "stripped_there")


# What candidates put behind a path (extensions, index names) or before it (source roots), part by part.
_SUFFIXES = sorted({x for e in [*EXTENSIONS.values(), *REWRITES.values(), *REWRITES, [".py", ".pyi", ".rs"]] for y in ([e] if isinstance(e, str) else e) for x in y.split(".") if x})
_NAMES = sorted({x for n in [*INDEX_NAMES, "src/index"] for x in n.split("/")})
_ROOTS = sorted({x for roots in [*SOURCE_ROOTS.values(), ["src/"]] for r in roots for x in r.split("/") if x})
_TAIL = rf"(?:/(?:{'|'.join(_NAMES)})|\.(?:{'|'.join(_SUFFIXES)}))+\z"
_HEAD = rf"^(?:/(?:{'|'.join(_ROOTS)})(?=/|\z))+"


def place(path: Column) -> Column:
    """One key for a path and all candidates made from it: the path without the parts that candidates add.

    Every candidate of an import has the place of the first one, so an import asks with one key, and a file is offered
    under one; the files of a place are a few, as they differ in those parts alone.
    """
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), _TAIL, ""), _HEAD, "")


def resolve_imports(
    imports: DataFrame,
    tree: DataFrame,
    modules: DataFrame | None = None,
    root_prefixes: DataFrame | None = None,
) -> DataFrame:
    """Adds kind (file / module / external / unresolved), target and reason.

    An import asks once, for the `place` of its candidates; it meets the tree's files of that place in one
    equi-join, and the first candidate among them wins.  The imports travel once (twice, if modules or prefixes
    are given).  ``modules(repo_id, name, path)``; ``root_prefixes(repo_id, prefix)``, of which the longest that fits
    counts.
    """
    own = imports.columns
    found = _own_directories(imports.withColumn("spec", F.trim("specifier")), tree, modules, root_prefixes)
    spec, lang, stripped = F.trim("specifier"), F.col("language"), F.col("stripped")
    bare = ~spec.startswith(".") & ~spec.startswith("/")
    module_dir = F.when(lang == "Go", stripped).when(bare, F.col("named_dir"))
    there = F.when(lang == "Go", F.col("stripped_there")).when(bare, F.col("named_there"))
    near = P.normalise_path(F.concat(P.dirname(F.col("path")), F.lit("/"), spec))
    base = F.col("base")

    def by_language(python: Column, rust: Column, rooted: Column, relative: Column, named: Column, prefixed: Column) -> Column:
        said = F.when(lang == "Python", python).when(lang == "Rust", rust).when(lang.isin(*SOURCE_ROOTS), rooted)
        said = said.when(lang == "Go", F.lit(None)).when(is_relative(spec), relative)
        return said.when(module_dir.isNotNull(), named).when(stripped.isNotNull(), prefixed)

    # The path that all candidates are made from: a column of its own, as it is used again and again.
    bases = by_language(_python_base(spec), _rust_base(spec), F.replace(spec, F.lit("."), F.lit("/")), near, module_dir, stripped)
    candidates = by_language(
        _python_candidates(spec, base), _rust_candidates(base), _absolute_candidates(base), _relative_candidates(base),
        _entry_candidates(base), _with_extensions(base),
    )
    # Without one nothing is asked: a key that no path has, dealt evenly.
    key = F.coalesce(place(base), F.concat(F.lit("\0"), F.col("path")), F.lit("\0")).alias("place")
    asked = found.withColumn("base", bases).select(*own, "named_dir", "stripped", F.when(there, module_dir).alias("held"), key)
    offered = tree.select("repo_id", place(F.col("path")).alias("place"), F.col("path").alias("file"))
    files = offered.groupBy("repo_id", "place").agg(F.collect_set("file").alias("files"))
    met = asked.join(files, ["repo_id", "place"], "left").withColumn("base", F.when(F.col("files").isNotNull(), bases))
    hit = F.get(F.filter(candidates, lambda c: F.array_contains("files", c)), F.lit(0))
    # Exploded, so that what is asked of the hit later is not asked here with the search written out each time.
    hit = F.explode(F.array(F.when(base.isNotNull(), hit))).alias("hit")
    # Imports that are alike are one; they lie together by their place.
    rows = met.select(*own, "stripped", "held", "place", hit).distinct()
    kind = (
        F.when(spec == "", "unresolved")
        .when(F.col("hit").isNotNull(), "file")
        .when(F.col("held").isNotNull(), "module")
        .when(spec.startswith("/") | spec.startswith("."), "unresolved")
        .when((lang == "Go") & stripped.isNotNull(), "unresolved")
        .otherwise("external")
    )
    reason = (
        F.when(spec == "", "nothing is named")
        .when(spec.startswith("/"), "a path from the disk root leads out of the repository")
        .when(spec.startswith("."), "the relative path leads to no file")
        .otherwise("the repository lacks the package's directory")
    )
    return rows.withColumn("kind", kind).select(
        *own,
        "kind",
        F.when(F.col("kind") == "file", F.col("hit"))
        .when(F.col("kind") == "module", F.col("held"))
        .when(F.col("kind") == "external", P.package_name_of(spec))
        .alias("target"),
        F.when(F.col("kind") == "unresolved", reason).alias("reason"),
    )
