"""Path projections and predicates.

Several predicates look alike (three kinds of "test path", two kinds of
"documentation").  They differ on purpose: each one decides a different result,
so they are kept apart.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory part without the slash; empty for a root file."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for dotfiles such as ``.env``."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def ancestor_dirs(path: Column) -> Column:
    """Every ancestor directory, shortest first (turns a prefix join into an equi-join)."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def normalise_path(path: Column) -> Column:
    """Collapse ``.`` and ``..``; null when the path escapes the root or is empty."""
    parts = F.filter(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != ".")
    )
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        # A null accumulator means "escaped the root" and stays null.
        return F.when(
            seg == "..",
            F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)),
        ).otherwise(F.concat(acc, F.array(seg)))

    folded = F.aggregate(parts, empty, step)
    return F.when(F.size(folded) > 0, F.array_join(folded, "/"))


def package_name_of(specifier: Column) -> Column:
    """``@scope/name/x`` -> ``@scope/name``; ``name/x`` -> ``name``."""
    found = F.regexp_extract(specifier, r"\A/*((?:@[^/]*/+)?[^/]+)", 1)
    return F.when(found == "", specifier).otherwise(F.regexp_replace(found, "/+", "/"))


def language_of(path: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(D.LANGUAGE_BY_EXTENSION)), "map<string,string>")
    return F.element_at(table, extension(path))


def among(value: Column, names: list[str]) -> Column:
    """Membership in a fixed list, as one folded constant instead of one literal per name."""
    return F.array_contains(F.split(F.lit("\n".join(names)), "\n"), value)


def is_programming_language(language: Column) -> Column:
    return language.isNotNull() & ~language.isin(*D.NON_PROGRAMMING_LANGUAGES)


def is_sample_material(path: Column) -> Column:
    return path.rlike(D.SAMPLE_MATERIAL)


def is_fixture(path: Column) -> Column:
    return path.rlike(D.FIXTURE_PATH)


def is_generated(path: Column) -> Column:
    return path.rlike(D.GENERATED_PATH)


def is_document(path: Column) -> Column:
    return path.rlike(D.DOCUMENT_PATH)


def is_prose(path: Column) -> Column:
    base = basename(path)
    ext = F.lower(F.regexp_extract(base, r"\A.+(\.[^.]*)\z", 1))
    return F.when(ext == "", among(F.lower(base), D.PROSE_BASENAMES)).otherwise(
        among(ext, D.PROSE_EXTENSIONS)
    )


def is_test_source(path: Column) -> Column:
    """Test path as the residue scanner sees it."""
    return path.rlike(D.RESIDUE_TEST_FILE)


def is_test_dir(path: Column) -> Column:
    """Test path as the entrypoint detector sees it."""
    return path.rlike(D.ENTRY_TEST_PATH)


def is_test_file(path: Column) -> Column:
    return is_test_dir(path) | path.rlike(D.TEST_FILE)


def is_config(path: Column) -> Column:
    return among(F.lower(basename(path)), D.CONFIG_BASENAMES) | path.rlike(D.CONFIG_PATH)


def is_documentation(path: Column) -> Column:
    base = basename(path)
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)\z", 1))
    return (
        among(ext, D.DOCUMENTATION_EXTENSIONS)
        | among(F.lower(base), D.DOCUMENTATION_BASENAMES)
        | path.startswith("docs/")
    )


def is_allowlisted_template(path: Column) -> Column:
    return basename(path).isin(*D.ALLOWLIST_TEMPLATES)


def severity_for_path(path: Column, severity: Column) -> Column:
    """Generated, fixture and document paths lower the severity."""
    soft = is_generated(path) | is_fixture(path) | is_document(path)
    return F.when(
        soft, F.when(severity == "critical", F.lit("medium")).otherwise(F.lit("low"))
    ).otherwise(severity)


def under_prefix(path: Column, prefix: str | None) -> Column:
    """Path-prefix test on a segment boundary; an empty prefix keeps everything."""
    clean = (prefix or "").removeprefix(".").removeprefix("/").rstrip("/")
    if clean in ("", "."):
        return F.lit(True)
    return (path == clean) | path.startswith(clean + "/")
