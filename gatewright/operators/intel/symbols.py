"""Declarations found by line rules, with their parents and extents.

A file stays one row throughout: its lines become an array of facts (indentation, braces, the rule that matches), one
fold over that array keeps the open blocks on stacks and gives the extent and the parent of each declaration, and only
the declarations found are exploded.  Nothing is shuffled and no window is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.functions.patterns import ascii_boundaries, convert
from gatewright.functions import paths as P
from gatewright.functions import text as X
from gatewright.operators.intel.graph import trimmed
from gatewright.operators.scale import top_k

# Language -> (block style, visibility, comment prefixes, rules).
# A rule is (pattern on the trimmed line, kind, opens a scope); the first that matches counts.
PROFILES: dict[str, tuple[str, str, list[str], list[tuple[str, str, bool]]]] = {
    "TypeScript": ("brace", "keyword", ["//"], [
        (r"^(?:export\s+)?(?:declare\s+)?class\s+([A-Za-z_$][\w$]*)", "class", True),
        (r"^(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface", True),
        (r"^(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)", "enum", True),
        (r"^(?:export\s+)?(?:declare\s+)?type\s+([A-Za-z_$][\w$]*)", "type", False),
        (r"^(?:export\s+)?(?:declare\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "function", False),
        (r"^(?:export\s+)?(?:declare\s+)?const\s+([A-Za-z_$][\w$]*)", "constant", False),
        (r"^(?:export\s+)?(?:declare\s+)?let\s+([A-Za-z_$][\w$]*)", "variable", False),
    ]),
    "JavaScript": ("brace", "keyword", ["//"], [
        (r"^(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", "class", True),
        (r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "function", False),
        (r"^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)", "constant", False),
        (r"^(?:export\s+)?let\s+([A-Za-z_$][\w$]*)", "variable", False),
        (r"^(?:export\s+)?var\s+([A-Za-z_$][\w$]*)", "variable", False),
    ]),
    "Go": ("brace", "capitalised", ["//"], [
        (r"^type\s+([A-Za-z_]\w*)\s+struct\b", "struct", True),
        (r"^type\s+([A-Za-z_]\w*)\s+interface\b", "interface", True),
        (r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", "function", False),
        (r"^const\s+([A-Za-z_]\w*)", "constant", False),
        (r"^var\s+([A-Za-z_]\w*)", "variable", False),
    ]),
    "Rust": ("brace", "keyword", ["//"], [
        (r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", "struct", True),
        (r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)", "enum", True),
        (r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)", "interface", True),
        (r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)", "function", False),
        (r"^(?:pub\s+)?const\s+([A-Za-z_]\w*)", "constant", False),
    ]),
    "Java": ("brace", "keyword", ["//"], [
        (r"^(?:public\s+|private\s+|protected\s+|final\s+|abstract\s+|static\s+)*class\s+([A-Za-z_]\w*)", "class", True),
        (r"^(?:public\s+|private\s+|protected\s+|abstract\s+)*interface\s+([A-Za-z_]\w*)", "interface", True),
        (r"^(?:public\s+|private\s+|protected\s+)*enum\s+([A-Za-z_]\w*)", "enum", True),
        (r"^(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|synchronized\s+|native\s+)*[A-Za-z_][\w<>\[\],.\s]*\s+([A-Za-z_]\w*)\s*\(", "function", False),
    ]),
    "Kotlin": ("brace", "keyword", ["//"], [
        (r"^(?:public\s+|private\s+|internal\s+|open\s+|sealed\s+|data\s+|abstract\s+|annotation\s+)*(?:class|object)\s+([A-Za-z_]\w*)", "class", True),
        (r"^(?:public\s+|private\s+|internal\s+)*interface\s+([A-Za-z_]\w*)", "interface", True),
        (r"^(?:public\s+|private\s+|internal\s+|suspend\s+|inline\s+|operator\s+|override\s+|open\s+)*fun\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)", "function", False),
        (r"^(?:public\s+|private\s+|internal\s+)*enum\s+class\s+([A-Za-z_]\w*)", "enum", True),
    ]),
    "Swift": ("brace", "keyword", ["//"], [
        (r"^(?:public\s+|private\s+|internal\s+|fileprivate\s+|open\s+|final\s+)*class\s+([A-Za-z_]\w*)", "class", True),
        (r"^(?:public\s+|private\s+|internal\s+|fileprivate\s+)*struct\s+([A-Za-z_]\w*)", "struct", True),
        (r"^(?:public\s+|private\s+|internal\s+|fileprivate\s+)*enum\s+([A-Za-z_]\w*)", "enum", True),
        (r"^(?:public\s+|private\s+|internal\s+|fileprivate\s+)*protocol\s+([A-Za-z_]\w*)", "interface", True),
        (r"^(?:public\s+|private\s+|internal\s+|fileprivate\s+|open\s+|static\s+|class\s+|override\s+|mutating\s+)*func\s+([A-Za-z_]\w*)", "function", False),
    ]),
    "Ruby": ("indent", "always", ["#"], [
        (r"^def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "function", False),
        (r"^class\s+([A-Za-z_]\w*)", "class", True),
        (r"^module\s+([A-Za-z_]\w*)", "class", True),
        (r"^([A-Z][A-Z0-9_]*)\s*=", "constant", False),
    ]),
    "Shell": ("indent", "always", ["#"], [
        (r"^(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{?", "function", False),
        (r"^([A-Z][A-Z0-9_]*)=", "constant", False),
    ]),
    "Protobuf": ("brace", "always", ["//"], [
        (r"^message\s+([A-Za-z_]\w*)", "struct", True),
        (r"^enum\s+([A-Za-z_]\w*)", "enum", True),
        (r"^service\s+([A-Za-z_]\w*)", "interface", True),
        (r"^rpc\s+([A-Za-z_]\w*)", "function", False),
    ]),
    "GraphQL": ("brace", "always", ["#"], [
        (r"^type\s+([A-Za-z_]\w*)", "struct", True),
        (r"^interface\s+([A-Za-z_]\w*)", "interface", True),
        (r"^enum\s+([A-Za-z_]\w*)", "enum", True),
        (r"^input\s+([A-Za-z_]\w*)", "struct", True),
    ]),
    "Python": ("indent", "underscore", ["#"], [
        (r"^class\s+([A-Za-z_]\w*)", "class", True),
        (r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", "function", True),
        (r"^([A-Za-z_]\w*)\s*(?::[^=]*)?=(?!=)", "assignment", False),
    ]),
    "Solidity": ("brace", "solidity", ["//", "/*", "*"], [
        (r"^(?:abstract\s+)?contract\s+([A-Za-z_]\w*)", "contract", True),
        (r"^library\s+([A-Za-z_]\w*)", "contract", True),
        (r"^interface\s+([A-Za-z_]\w*)", "interface", True),
        (r"^function\s+([A-Za-z_]\w*)", "function", False),
        (r"^(constructor|fallback|receive)\s*\(", "function", False),
        (r"^modifier\s+([A-Za-z_]\w*)", "function", False),
        (r"^event\s+([A-Za-z_]\w*)", "type", False),
        (r"^error\s+([A-Za-z_]\w*)", "type", False),
        (r"^struct\s+([A-Za-z_]\w*)", "struct", False),
        (r"^enum\s+([A-Za-z_]\w*)", "enum", False),
        (r"^(?:mapping\s*\([^)]*\)|[A-Za-z_]\w*(?:\[\])?)\s+(?:public|private|internal|external|immutable|constant|override|virtual|\s)*\s*([A-Za-z_]\w*)\s*(?:=|;)", "state", False),
    ]),
}
PARSERS = {"Python": ("regex", 0.75), "Solidity": ("regex", 0.7)}
HEURISTIC = ("heuristic", 0.5)
INDENT_LANGUAGES = [k for k, v in PROFILES.items() if v[0] == "indent"]
TAB_WIDTH = 4
FILE = ["repo_id", "path"]

# How a language's blocks are told: by braces; by braces, left on ignorable lines too; by indentation; by indentation,
# where a scope's content is two columns further in.
BRACE, SOLIDITY, INDENT, INDENT_BY_TWO = range(4)
# What a line declares: nothing, something, a scope, a Python function, a Python assignment, a state variable.
NOTHING, PLAIN, SCOPE, FUNCTION, ASSIGNMENT, STATE = range(6)
# Bits of a line's mark, below what it declares.
_IGNORABLE, _OPENS, _DECORATOR, _TERMINATOR, _SHIFT = 1, 2, 4, 8, 4


def strip_non_code(text: Column) -> Column:
    """Drop quoted strings and ``//`` comments, scanning left to right."""
    bare = F.regexp_replace(text, r"""\\["'\\]""", "")
    return F.regexp_replace(bare, r"""("[^"]*("|\z))|('[^']*('|\z))|(//.*)""", "")


def _first_rule(language: Column, line: Column) -> Column:
    """struct(name, kind, scope) of the first rule of the line's language that matches; null if none does."""
    options = []
    for name, (_, _, _, rules) in convert(PROFILES).items():
        hits = [
            F.when(
                line.rlike(pattern),
                F.struct(F.regexp_extract(line, pattern, 1).alias("name"), F.lit(kind).alias("kind"), F.lit(scope).alias("scope")),
            )
            for pattern, kind, scope in rules
        ]
        options.append(F.when(language == name, F.coalesce(*hits)))
    return F.coalesce(*options)


def line_facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, lines): one row per file of a supported language, with the facts of all its lines.

    A line is a struct of t (trimmed text), indent, opens, closes (braces outside strings and comments), ignorable
    (blank or a comment) and rule (name, kind, scope; null without a declaration).
    """
    language = F.col("language")

    def cut(line: Column) -> Column:
        lead = F.regexp_extract(line, r"\A([ \t]*)", 1)
        return F.struct(X.strip_space(line).alias("t"), lead.alias("lead"), strip_non_code(line).alias("code"))

    def measured(line: Column) -> Column:
        t, lead, code = line["t"], line["lead"], line["code"]
        ignorable = t == ""
        for name, (_, _, prefixes, _) in PROFILES.items():
            for prefix in prefixes:
                ignorable = ignorable | ((language == name) & t.startswith(prefix))
        braces = lambda ch: F.length(code) - F.length(F.replace(code, F.lit(ch), F.lit("")))
        tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
        return F.struct(
            t.alias("t"),
            (F.length(lead) + (TAB_WIDTH - 1) * tabs).alias("indent"),
            braces("{").alias("opens"),
            braces("}").alias("closes"),
            ignorable.alias("ignorable"),
        )

    def ruled(line: Column) -> Column:
        return line.withField("rule", F.when(~line["ignorable"], _first_rule(language, line["t"])))

    rows = files.where(F.col("content").isNotNull()).withColumn("language", P.language_of(F.col("path")))
    lines = F.transform(F.transform(F.transform(X.lines_of(F.col("content")), cut), measured), ruled)
    return rows.where(language.isin(*PROFILES)).select(*FILE, "language", lines.alias("lines"))


def _running(values: list[int]) -> list[int]:
    return np.cumsum(np.array(values, np.int64)).tolist() if values else []


def _depths(nets: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in nets:
        yield pa.array([None if n is None else _running(n) for n in batch.to_pylist()], pa.list_(pa.int64()))


_depths.__annotations__ = {"nets": Iterator[pa.Array], "return": Iterator[pa.Array]}
_depths_of = F.arrow_udf(_depths, T.ArrayType(T.LongType()))


def _nets(lines: Column) -> Column:
    return F.transform(lines, lambda x: x["opens"] - x["closes"])


def brace_depth(facts: DataFrame) -> DataFrame:
    """(repo_id, path, line, depth_after, depth_before): open braces around every line of facts(..., lines)."""
    deep = facts.select(*FILE, _nets(F.col("lines")).alias("net"), _depths_of(_nets(F.col("lines"))).alias("after"))
    each = deep.select(*FILE, F.posexplode(F.arrays_zip("net", "after")).alias("at", "x"))
    return each.select(
        *FILE, (F.col("at") + 1).alias("line"), F.col("x.after").alias("depth_after"), (F.col("x.after") - F.col("x.net")).alias("depth_before")
    )


def declarations(facts: DataFrame) -> DataFrame:
    """(repo_id, path, language, line, name, kind, scope): every line of facts(..., lines) that a rule matches."""
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x["rule"].alias("rule")))
    found = facts.select(*FILE, "language", F.explode(F.filter(numbered, lambda x: x["rule"].isNotNull())).alias("d"))
    return found.select(*FILE, "language", "d.line", "d.rule.*")


def fold_braces(style: int, nets: list[int], marks: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(line, start, end, line of the parent or 0) of the declarations of a file whose blocks stand in braces.

    A block ends on the first line, from the first opening brace on, after which no more braces are open than before
    its declaration; one that opens or closes nowhere ends on its own line.  A scope lasts while as many braces are
    open as inside it.
    """
    found: list[list[int]] = []
    waiting: list[tuple[int, list[int]]] = []  # (depth before, row) of declarations without a brace so far
    standing: dict[int, list[list[int]]] = {}  # those with one, by the depth that ends them
    scopes: list[tuple[int, int]] = []
    depth = 0
    for line, (net, mark) in enumerate(zip(nets, marks), 1):
        if style == SOLIDITY or not mark & _IGNORABLE:
            while scopes and depth < scopes[-1][0]:
                scopes.pop()
        role = mark >> _SHIFT
        inside = scopes[-1] if scopes else (None, 0)
        if role and (role != STATE or depth == inside[0]):
            row = [line, line, line, inside[1]]
            found.append(row)
            if role != STATE:
                waiting.append((depth, row))
            if role == SCOPE:
                scopes.append((depth + 1, line))
        after = depth + net
        if mark & _OPENS:
            for base, row in waiting:
                if after <= base:
                    row[2] = line
                else:
                    standing.setdefault(base, []).append(row)
            waiting = []
        for base in range(after, depth) if standing else ():
            for row in standing.pop(base, ()):
                row[2] = line
        depth = after
    return map(tuple, found)


def fold_indents(style: int, indents: list[int], marks: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """The same for a file whose blocks are told by indentation.

    A block ends on the last line of code before the next one that is not further in, or on that one if it is the
    block's terminator.  It starts at the first of the decorators right above.  Python assignments count outside
    functions alone and scopes that are functions are no parents.
    """
    found: list[list[int]] = []
    standing: list[tuple[int, list[int]]] = []
    scopes: list[tuple[int, int, bool]] = []  # (indent, line, whether a function)
    functions = last = 0
    decorated: tuple[int, int] | None = None  # (indent, first line) of the decorators right above
    for line, (indent, mark) in enumerate(zip(indents, marks), 1):
        if mark & _IGNORABLE:
            continue
        while standing and standing[-1][0] >= indent:
            base, row = standing.pop()
            row[2] = line if base == indent and mark & _TERMINATOR else last
        while scopes and scopes[-1][0] + (style == INDENT_BY_TWO) >= indent:
            functions -= scopes.pop()[2]
        start = decorated[1] if decorated and decorated[0] == indent else line
        role = mark >> _SHIFT
        if role and (role != ASSIGNMENT or not functions):
            parent = next((at for _, at, function in reversed(scopes) if not function), 0)
            row = [line, line if role == ASSIGNMENT else start, line, parent]
            found.append(row)
            if role != ASSIGNMENT:
                standing.append((indent, row))
            if role in (SCOPE, FUNCTION):
                scopes.append((indent, line, role == FUNCTION))
                functions += role == FUNCTION
        decorated = (indent, start) if mark & _DECORATOR else None
        last = line
    for _, row in standing:
        row[2] = last
    return map(tuple, found)


_EXTENT = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("line", "start", "end", "parent")]))
_EXTENT_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("line", "start", "end", "parent")]))


def _extents(files: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    names = _EXTENT_ARROW.value_type.names
    for styles, places, marks in files:
        out = []
        for style, place, mark in zip(styles.to_pylist(), places.to_pylist(), marks.to_pylist()):
            fold = fold_braces if style in (BRACE, SOLIDITY) else fold_indents
            out.append([dict(zip(names, row)) for row in fold(style, place, mark)])
        yield pa.array(out, _EXTENT_ARROW)


_extents.__annotations__ = {"files": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
_extents_of = F.arrow_udf(_extents, _EXTENT)


def extents(facts: DataFrame) -> DataFrame:
    """`facts` with `found`: array of (line, start, end, parent) of the declarations that count, in order of lines.

    Only two numbers a line leave the JVM.
    """
    language = F.col("language")
    style = (
        F.when(language == "Solidity", SOLIDITY)
        .when(language.isin("Ruby", "Shell"), INDENT_BY_TWO)
        .when(language.isin(*INDENT_LANGUAGES), INDENT)
        .otherwise(BRACE)
    )
    by_indent = language.isin(*INDENT_LANGUAGES)
    places = F.transform("lines", lambda x: F.when(by_indent, x["indent"]).otherwise(x["opens"] - x["closes"]))

    def mark(x: Column) -> Column:
        kind = x["rule"]["kind"]
        role = (
            F.when(kind.isNull(), NOTHING)
            .when(kind == "assignment", ASSIGNMENT)
            .when(kind == "state", STATE)
            .when((language == "Python") & (kind == "function"), FUNCTION)
            .when(x["rule"]["scope"], SCOPE)
            .otherwise(PLAIN)
        )
        ends = ((language == "Ruby") & x["t"].rlike(ascii_boundaries(r"^end\b"))) | ((language == "Shell") & x["t"].startswith("}"))
        bits = (
            F.when(x["ignorable"], _IGNORABLE).otherwise(0)
            + F.when(x["opens"] > 0, _OPENS).otherwise(0)
            + F.when((language == "Python") & x["t"].startswith("@"), _DECORATOR).otherwise(0)
            + F.when(ends, _TERMINATOR).otherwise(0)
        )
        return bits + F.shiftleft(role, _SHIFT)

    return facts.withColumn("found", _extents_of(style, places, F.transform("lines", mark)))


def extract_symbols(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo_id, path, name, kind, start_line, end_line, parent, exported, language, parser, confidence)."""
    lang = F.col("language")

    def described(x: Column) -> Column:
        line = F.element_at("lines", x["line"])
        parent = F.when(x["parent"] > 0, F.element_at("lines", x["parent"])["rule"]["name"])
        return F.struct(
            line["rule"]["name"].alias("name"), line["rule"]["kind"].alias("kind"), line["t"].alias("t"),
            x["start"].alias("start_line"), x["end"].alias("end_line"), parent.alias("parent"),
        )

    rows = extents(line_facts(files)).select(*FILE, "language", F.explode(F.transform("found", described)).alias("d")).select(*FILE, "language", "d.*")
    kind, name, t = F.col("kind"), F.col("name"), F.col("t")
    python = lang == "Python"
    constant = F.when(python, name.rlike(r"^[A-Z][A-Z0-9_]*\z")).otherwise(t.rlike(ascii_boundaries(r"\bconstant\b")))
    final_kind = (
        F.when(python & (kind == "function") & F.col("parent").isNotNull(), "method")
        .when(kind.isin("assignment", "state"), F.when(constant, "constant").otherwise("variable"))
        .otherwise(kind)
    )
    outside = t.rlike(ascii_boundaries(r"\b(public|external)\b"))
    visible = {
        "capitalised": name.rlike("^[A-Z]"),
        "keyword": t.rlike(ascii_boundaries(r"^(?:pub\b|public\b|export\b|open\b)")),
        "underscore": ~name.startswith("_"),
        "solidity": kind.isin("contract", "interface") | outside,
    }
    exported = F.lit(True)
    for style, test in visible.items():
        names = [k for k, v in PROFILES.items() if v[1] == style]
        exported = F.when(lang.isin(*names), test).otherwise(exported)
    symbols = rows.select(
        *FILE,
        "name",
        final_kind.alias("kind"),
        "start_line",
        "end_line",
        "parent",
        exported.alias("exported"),
        "language",
        F.when(lang.isin(*PARSERS), "regex").otherwise("heuristic").alias("parser"),
        F.when(python, 0.75).when(lang == "Solidity", 0.7).otherwise(0.5).alias("confidence"),
    )
    return top_k(symbols, ["repo_id"], [F.col("path"), F.col("start_line"), F.col("name")], limit).drop("rank")


def symbol_coverage(text: DataFrame, files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Per (repo, language): parsed files, the parser used, files skipped and why."""
    rows = (
        text.withColumn("language", P.language_of(F.col("path")))
        .where(P.is_programming_language(F.col("language")))
        .join(files.where(F.col("content").isNotNull()).select(*FILE), FILE, "left_semi")
    )
    big = F.lit(False) if max_file_bytes is None else F.col("size") > max_file_bytes
    known = F.col("language").isin(*PROFILES)
    parser = F.when(~known, F.lit(None)).when(F.col("language").isin(*PARSERS), "regex").otherwise("heuristic")
    return rows.groupBy("repo_id", "language").agg(
        F.count_if(known & ~big).alias("file_count"),
        F.count_if(big).alias("oversize"),
        F.count_if(~known & ~big).alias("unsupported"),
        F.max(parser).alias("parser"),
        F.max(F.col("language").isin("TypeScript", "JavaScript")).alias("degraded"),
    )


def symbol_view(symbols: DataFrame, prefix: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbols under a path prefix (with ``limit`` the first), and the accounting of what was left out."""
    inside = symbols.where(P.under_prefix(F.col("path"), prefix))
    kept = top_k(inside, ["repo_id"], [F.col("path"), F.col("start_line"), F.col("name")], limit)
    return kept, trimmed(inside, limit, "symbols")
