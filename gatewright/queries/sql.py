"""Small helpers to write reference SQL from the fixed rule tables."""

from __future__ import annotations

from gatewright import dims as D


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(q(v) for v in values)})"


def hit(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {q(pattern)}), false)"


def case(pairs, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


BASE = "regexp_extract({0}, '([^/]*)$', 1)"
EXT = r"lower(regexp_extract({0}, '[^/](\.[^./]*)$', 1))"


def base(path: str) -> str:
    return BASE.format(path)


def ext(path: str) -> str:
    return EXT.format(path)


def dirname(path: str) -> str:
    return rf"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '' END"


def slug(expr: str) -> str:
    return f"lower(regexp_replace(regexp_replace({expr}, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g'))"


def kind(path: str = "path", size: str = "size") -> str:
    b, e = base(path), ext(path)
    return case(
        [
            (f"regexp_matches({path}, {q(D.SKIP_DIR_ANYWHERE)}) OR regexp_matches({path}, {q(D.SKIP_DIR_AT_ROOT)})"
             f" OR contains({path}, '..')", "'ignore'"),
            (f"{b} = '.env' OR starts_with({b}, '.env.') OR {any_of(b, D.TEXT_DOTFILES)}", "'text'"),
            (f"starts_with({b}, '.')", "'ignore'"),
            (any_of(e, D.BINARY_EXTENSIONS), "'binary'"),
            (f"{any_of(e, D.TEXT_EXTENSIONS)} OR {any_of(f'lower({b})', D.BARE_TEXT_NAMES)} OR {size} <= {D.SMALL_TEXT_BYTES}",
             "'text'"),
        ],
        "'binary'",
    )


def language(path: str = "path") -> str:
    e = ext(path)
    groups: dict[str, list[str]] = {}
    for k, v in D.LANGUAGE_BY_EXTENSION.items():
        groups.setdefault(v, []).append(k)
    return case([(any_of(e, v), q(k)) for k, v in groups.items()])


def programming(lang: str) -> str:
    return f"({lang} IS NOT NULL AND NOT {any_of(lang, D.NON_PROGRAMMING_LANGUAGES)})"


def soft_path(path: str) -> str:
    return " OR ".join(hit(path, p) for p in (D.GENERATED_PATH, D.FIXTURE_PATH, D.DOCUMENT_PATH))


def severity_for(path: str, severity: str) -> str:
    return (
        f"CASE WHEN {soft_path(path)} THEN CASE WHEN {severity} = 'critical' THEN 'medium' ELSE 'low' END"
        f" ELSE {severity} END"
    )


def rank(severity: str) -> str:
    return f"CASE {severity} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def severity_of_rank(r: str) -> str:
    return f"CASE {r} WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


def prose(path: str = "path") -> str:
    b = base(path)
    e = rf"lower(regexp_extract({b}, '^.+(\.[^.]*)$', 1))"
    return (
        f"CASE WHEN {e} = '' THEN {any_of(f'lower({b})', D.PROSE_BASENAMES)} ELSE {any_of(e, D.PROSE_EXTENSIONS)} END"
    )


def fnv(text: str) -> str:
    """Two FNV-1a halves over the characters of an ASCII string."""
    half = (
        "printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, [unicode(x)::BIGINT FOR x IN"
        " string_split({t} || chr(0) || '{s}', '')]), LAMBDA h, c: (xor(h, c) * 16777619) & 4294967295))"
    )
    return half.format(t=text, s="a") + " || " + half.format(t=text, s="b")


def rule_id(fid: str) -> str:
    pairs = [(f"{fid} = {q(k)}", q(v[0])) for k, v in D.EXACT_RULES.items()]
    longest = sorted(D.PREFIX_RULES.items(), key=lambda kv: -len(kv[0]))
    pairs += [(f"starts_with({fid}, {q(k)})", q(v[0])) for k, v in longest]
    return case(pairs, f"'UNMAPPED-' || regexp_replace(upper({fid}), '[^A-Z0-9]+', '-', 'g')")


def rule_source(fid: str) -> str:
    pairs = [(f"{fid} = {q(k)}", q(v[1])) for k, v in D.EXACT_RULES.items()]
    longest = sorted(D.PREFIX_RULES.items(), key=lambda kv: -len(kv[0]))
    pairs += [(f"starts_with({fid}, {q(k)})", q(v[1])) for k, v in longest]
    return case(pairs, "'file'")


# Graded tree and corpus, as the audit sees them.
GRADED = f"graded AS (SELECT *, {kind()} AS kind FROM tree)"
CORPUS = f"""{GRADED}, corpus AS (
SELECT g.repo_id, g.path, g.size, g.list_pos, g.kind = 'text' AS admitted,
 CASE WHEN g.kind = 'text' THEN f.content END AS content
FROM graded AS g LEFT JOIN files AS f ON f.repo_id = g.repo_id AND f.path = g.path)"""
