"""Content scanners: injection, residue, secrets, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators import admission, history, injection, residue, secrets
from gatewright.queries import sql as S
from gatewright.queries.registry import query, view
from gatewright.sources.tables import run_folder

_DOC_LINES = r"""x AS (SELECT repo_id, path, string_split_regex(content, '\r?\n') AS a FROM doc_files),
dl AS (SELECT repo_id, path, CAST(i AS INT) AS line, a[i] AS text FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM x)),
al AS (SELECT repo_id, path, line, text FROM dl UNION ALL SELECT repo_id, path, line, text FROM conv_lines)"""


def _all_lines(spark, d):
    docs = admission.explode_lines(view(spark, d, "doc_files").select("repo_id", "path", "content"))
    return docs.unionByName(view(spark, d, "conv_lines"))


_PHRASE = S.case([(f"regexp_matches(text, {S.q(f'(?i)\b{p}\b'.replace(chr(8), chr(92) + 'b'))})", S.q(p)) for p in D.INSTRUCTION_PHRASES])
_ROLE = f"CASE WHEN regexp_extract(text, {S.q(D.ROLE_MARKER)}, 1) <> '' THEN lower(regexp_extract(text, {S.q(D.ROLE_MARKER)}, 1)) || ':' END"
_HIDDEN = f"len(regexp_extract_all(text, {S.q(D.INVISIBLE_CHARS)}))"
_HITS = f"""{_DOC_LINES}, hits AS (
SELECT repo_id, path, line, coalesce({_PHRASE}, {_ROLE}) AS keyword FROM al WHERE {S.prose()} AND coalesce({_PHRASE}, {_ROLE}) IS NOT NULL
UNION ALL SELECT repo_id, path, line, '<invisible-unicode>' FROM al WHERE {_HIDDEN} >= {D.MIN_INVISIBLE})"""


@query("injection_hits", f"WITH {_HITS} SELECT * FROM hits")
def injection_hits(spark, d):
    files = view(spark, d, "doc_files").select("repo_id", "path", "content")
    hits = injection.injection_hits(files).unionByName(injection.line_hits(view(spark, d, "conv_lines")))
    return hits.select("repo_id", "path", "line", "keyword")


@query(
    "injection_findings",
    f"WITH {_HITS} SELECT repo_id, 'injection-' || {S.slug('path')} AS id, 'low' AS severity, count(*) AS proofs, CAST(min(line) AS INT) AS first_line FROM hits GROUP BY repo_id, path",
)
def injection_findings(spark, d):
    files = view(spark, d, "doc_files").select("repo_id", "path", "content")
    hits = injection.injection_hits(files).unionByName(injection.line_hits(view(spark, d, "conv_lines")))
    out = injection.injection_findings(hits)
    return out.select(
        "repo_id", "id", "severity", F.size("evidence").cast("bigint").alias("proofs"),
        F.col("evidence")[0]["line"].alias("first_line"),
    )


# --- residue: the source files of the derived corpus -------------------------------------------
def _sources(spark, d):
    return view(spark, d, "files").select("repo_id", "path", "content")


_SRC = f"src AS (SELECT repo_id, path, content FROM files WHERE {S.hit('path', D.RESIDUE_SOURCE_FILE)} AND content IS NOT NULL)"


def _placed(pattern: str, name: str, source: str = "src") -> str:
    """Matches of a pattern with the line each starts on: newlines of everything before it."""
    p = S.q(pattern)
    return f"""{name}_m AS (SELECT repo_id, path, string_split_regex(content, {p}) AS pieces, regexp_extract_all(content, {p}) AS ms FROM {source}),
{name} AS (SELECT repo_id, path, i AS nth, ms[i] AS what, CAST(1 + length(array_to_string(pieces[1:i], '') || array_to_string(ms[1:i-1], ''))
  - length(replace(array_to_string(pieces[1:i], '') || array_to_string(ms[1:i-1], ''), chr(10), '')) AS INT) AS line
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m))"""


@query("empty_catch", f"WITH {_SRC}, {_placed(D.EMPTY_CATCH, 'h')} SELECT repo_id, path, line FROM h")
def empty_catch(spark, d):
    return residue.empty_catch(_sources(spark, d)).select("repo_id", "path", "line")


@query(
    "unfinished_markers",
    f"WITH {_SRC}, {_placed(D.UNFINISHED_MARKER, 'h')} SELECT repo_id, path, line, regexp_extract(what, '(\\w+)$', 1) AS marker FROM h",
)
def unfinished_markers(spark, d):
    out = residue.unfinished_markers(_sources(spark, d))
    return out.select("repo_id", "path", "line", F.regexp_extract("what", r"(\w+)\z", 1).alias("marker"))


@query(
    "mock_in_production",
    f"WITH {_SRC}, {_placed(D.MOCK_IMPORT, 'h')} SELECT repo_id, path, line FROM h WHERE nth = 1 AND NOT {S.hit('path', D.RESIDUE_TEST_FILE)}",
)
def mock_in_production(spark, d):
    return residue.mock_in_production(_sources(spark, d)).select("repo_id", "path", "line")


_WHOLE = D.FUNCTION_START.replace(r"(\w+)", D.CHECK_NAME) + r"[^{]*" + D.CONSTANT_BODY


@query(
    "placeholder_returns",
    f"WITH {_SRC}, {_placed(_WHOLE, 'h')} SELECT repo_id, path, line, coalesce(nullif(regexp_extract(what, '^function\\s+(\\w+)', 1), ''), regexp_extract(what, '^\\w+\\s+(\\w+)', 1)) AS name FROM h",
)
def placeholder_returns(spark, d):
    out = residue.placeholder_returns(_sources(spark, d))
    return out.select("repo_id", "path", "line", F.col("what").alias("name"))


_WINDOWS = f"""ls AS (SELECT repo_id, path, list_transform(string_split_regex(content, '\\r?\\n'), LAMBDA s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS a FROM doc_files),
w AS (SELECT repo_id, path, i AS start, a[i:i+4] AS b FROM (SELECT *, unnest(range(1, len(a) - 3)) AS i FROM ls WHERE len(a) >= 5)),
k AS (SELECT repo_id, path, CAST(start AS INT) AS start, sha256(array_to_string(b, chr(10))) AS key FROM w WHERE NOT list_contains(b, '') AND length(regexp_replace(array_to_string(b, ''), '\\s', '', 'g')) >= {D.DUPLICATE_MIN_CHARS})"""


def _doc_windows(spark, d):
    files = view(spark, d, "doc_files").select("repo_id", "path", "size", "content")
    return residue.block_windows(files, length=5, min_logic=0)


@query(
    "duplicate_windows_file",
    f"WITH {_WINDOWS} SELECT repo_id, path, start, key, copies, CAST(first_start AS INT) AS first_start FROM (SELECT *, count(*) OVER (PARTITION BY repo_id, path, key) AS copies, min(start) OVER (PARTITION BY repo_id, path, key) AS first_start FROM k) WHERE copies > 1",
)
def duplicate_windows_file(spark, d):
    return residue.repeated_windows(_doc_windows(spark, d), "file")


@query(
    "duplicate_windows_corpus",
    f"WITH {_WINDOWS} SELECT repo_id, path, start, key, copies, CAST(first_start AS INT) AS first_start FROM (SELECT *, count(*) OVER (PARTITION BY key) AS copies, min(start) OVER (PARTITION BY key) AS first_start FROM k) WHERE copies > 1",
)
def duplicate_windows_corpus(spark, d):
    return residue.repeated_windows(_doc_windows(spark, d), "corpus", run_folder(spark))


@query("duplicate_blocks")
def duplicate_blocks(spark, d):
    files = view(spark, d, "doc_files").select("repo_id", "path", "size", "content")
    return residue.duplicate_blocks(files, length=5, min_logic=0)


_LOGIC = (
    "t <> '' AND NOT (" + " OR ".join(f"regexp_matches(t, {S.q(p)})" for p in D.NOT_LOGIC) + ") AND ("
    + f"regexp_matches(t, {S.q(D.LOGIC_SQL)}) OR regexp_matches(t, {S.q(D.LOGIC_CODE)}))"
)


@query(
    "logic_lines",
    f"WITH s AS (SELECT repo_id, path, ord, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM code_lines) SELECT repo_id, path, count(*) AS lines, count(*) FILTER (WHERE {_LOGIC}) AS logic FROM s GROUP BY 1, 2",
)
def logic_lines(spark, d):
    lines = view(spark, d, "code_lines")
    return lines.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(residue.logic_line(F.col("text"))).alias("logic")
    )


@query(
    "residue_findings",
    f"""WITH {_SRC}, {_placed(_WHOLE, 'p')}, {_placed(D.EMPTY_CATCH, 'c')}, {_placed(D.MOCK_IMPORT, 'k')}, {_placed(D.UNFINISHED_MARKER, 'm')},
u AS (SELECT repo_id, path, line, nth, 'ai-placeholder-return-' AS f, 'high' AS s FROM p UNION ALL SELECT repo_id, path, line, nth, 'ai-empty-catch-', 'medium' FROM c
 UNION ALL SELECT repo_id, path, line, nth, 'ai-mock-in-production-', 'medium' FROM k WHERE nth = 1 AND NOT {S.hit('path', D.RESIDUE_TEST_FILE)}
 UNION ALL SELECT repo_id, path, line, nth, 'ai-todo-in-implementation-', 'low' FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, f ORDER BY nth) AS n FROM u)
SELECT repo_id, f || {S.slug("path")} || CASE WHEN f LIKE 'ai-mock%' THEN '' ELSE '-' || CAST(line AS VARCHAR) END AS id, {S.severity_for("path", "s")} AS severity, path AS file, line FROM r""",
)
def residue_findings(spark, d):
    files = _sources(spark, d)
    hits = residue.placeholder_returns(files)
    for scan in (residue.empty_catch, residue.mock_in_production, residue.unfinished_markers):
        hits = hits.unionByName(scan(files))
    out = residue.residue_findings(hits)
    first = F.get("evidence", F.lit(0))
    return out.select("repo_id", "id", "severity", first["file"].alias("file"), first["line"].alias("line"))


# --- secrets ----------------------------------------------------------------------------------
_SAMPLE = lambda c: (
    "(" + " OR ".join(f"contains(lower({c}), {S.q(w)})" for w in D.SAMPLE_SUBSTRINGS) + f" OR regexp_matches({c}, {S.q(D.SAMPLE_PATTERN)}))"
)
_PLACE_DB = (
    "(contains(lower(m), 'localhost') OR contains(lower(m), '127.0.0.1')"
    f" OR regexp_matches(m, {S.q(D.PLACEHOLDER_DB_HOST)}) OR regexp_matches(m, {S.q(D.PLACEHOLDER_DB_PASSWORD)}))"
)
_TEMPLATE = S.any_of(S.base("path"), D.ALLOWLIST_TEMPLATES)


def _rule_sql(rule) -> str:
    kind, sev, _, pattern = rule
    if kind == "private_key":
        cond = f"regexp_matches(text, {S.q(pattern)})"
    else:
        bad = _PLACE_DB if kind == "db_url" else _SAMPLE("m")
        cond = f"len(list_filter(regexp_extract_all(text, {S.q(pattern)}), LAMBDA m: NOT {bad})) > 0"
    if kind in D.TEMPLATE_ONLY_KINDS:
        cond += f" AND NOT {_TEMPLATE}"
    return f"SELECT repo_id, path, line, '{kind}' AS kind, '{sev}' AS severity FROM secret_lines WHERE {cond}"


_PATTERN_SQL = " UNION ALL ".join(_rule_sql(r) for r in D.SECRET_RULES)


@query("secret_pattern_hits", _PATTERN_SQL)
def secret_pattern_hits(spark, d):
    out = secrets.secret_pattern_hits(view(spark, d, "secret_lines"))
    return out.select("repo_id", "path", "line", "kind", "severity")


def _entropy(t: str) -> str:
    return f"list_sum([-(CAST(len(list_filter(string_split({t}, ''), LAMBDA z: z = c)) AS DOUBLE) / length({t})) * log2(CAST(len(list_filter(string_split({t}, ''), LAMBDA y: y = c)) AS DOUBLE) / length({t})) FOR c IN list_distinct(string_split({t}, ''))])"


def _tokens(source: str) -> str:
    return f"""u AS (SELECT repo_id, path, line, regexp_replace(text, '(?i)\\bhttps?://[^\\s)>\\]}}"''`]+', ' ', 'g') AS text FROM {source}),
tk AS (SELECT *, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{32,}}')) AS tok FROM u),
va AS (SELECT *, regexp_replace(tok, '=+$', '') AS bare FROM tk),
vb AS (SELECT repo_id, path, line, text, CASE WHEN (regexp_matches(bare, '^[A-Za-z_]+=.') OR regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9_]*=.') AND contains(split_part(bare, '=', 1), '_')) THEN substr(bare, strpos(bare, '=') + 1) ELSE tok END AS v FROM va),
ve AS (SELECT *, {_entropy("v")} AS h FROM vb WHERE length(v) >= 32)"""


@query(
    "shannon_entropy",
    f"WITH {_DOC_LINES}, {_tokens('dl')} SELECT repo_id, path, line, md5(v) AS token_md5, round(h, 6) AS entropy FROM ve",
)
def shannon_entropy(spark, d):
    from gatewright.functions import text as X

    files = view(spark, d, "doc_files").select("repo_id", "path", "content")
    lines = admission.explode_lines(files, keep=F.col("content").rlike(secrets.token_pattern()))
    tokens = lines.select(
        "repo_id", "path", "line",
        F.explode(F.regexp_extract_all(X.strip_urls(F.col("text")), F.lit(secrets.token_pattern()), F.lit(0))).alias("t"),
    ).withColumn("t", F.coalesce(X.assignment_value(F.col("t")), F.col("t"))).where(F.length("t") >= 32)
    return tokens.select(
        "repo_id", "path", "line", F.md5("t").alias("token_md5"),
        F.round(X.shannon_entropy(F.col("t")), 6).alias("entropy"),
    )


# Shapes without look-around: a UUID or address cannot fill a 32-character token of these lines.
_RUN = (
    "len(string_split_regex(v, '[-/]')) >= 3 AND len(list_filter(string_split_regex(v, '[-/]'), LAMBDA s: NOT regexp_matches(s, '^[A-Za-z0-9]{2,}$'))) = 0"
    " AND len(list_filter(string_split_regex(v, '[-/]'), LAMBDA s: regexp_matches(s, '^[A-Za-z]{3,}$'))) >= 2"
)
_STEM = f"regexp_matches(substr(text, strpos(text, v) + length(v)), {S.q('(?i)^' + chr(92) + '.(?:' + '|'.join(D.FILE_SUFFIXES) + ')' + chr(92) + 'b')})"
_SHAPE = S.case(
    [
        (_SAMPLE("v"), "'sample-placeholder'"),
        (f"regexp_matches(v, {S.q(D.DIGEST_PATTERN)})", "'integrity-digest'"),
        (f"regexp_matches(v, {S.q(D.IDENTIFIER_PATTERN)})", "'separator-identifier'"),
        (f"({_RUN}) OR ({_STEM})", "'path-or-name-run'"),
    ]
)


@query(
    "non_credential_shape",
    f"WITH {_tokens('secret_lines')} SELECT repo_id, path, line, coalesce({_SHAPE}, 'none') AS shape, count(*) AS tokens FROM ve GROUP BY ALL",
)
def non_credential_shape(spark, d):
    from gatewright.functions import text as X

    rows = view(spark, d, "secret_lines").withColumn("text", X.strip_urls(F.col("text")))
    pattern = F.lit(secrets.token_pattern())
    tokens = rows.select("*", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("t"))
    tokens = tokens.withColumn("t", F.coalesce(X.assignment_value(F.col("t")), F.col("t"))).where(F.length("t") >= 32)
    shape = F.coalesce(secrets.non_credential_shape(F.col("t"), F.col("text")), F.lit("none"))
    return tokens.groupBy("repo_id", "path", "line", shape.alias("shape")).agg(F.count(F.lit(1)).alias("tokens"))


_ENTROPY_SQL = f"SELECT DISTINCT repo_id, path, line, 'generic_high_entropy' AS kind, 'medium' AS severity FROM ve WHERE h >= 4.0 - 1e-12 AND NOT {_TEMPLATE} AND {_SHAPE} IS NULL"


@query("entropy_hits", f"WITH {_tokens('secret_lines')} {_ENTROPY_SQL}")
def entropy_hits(spark, d):
    out = secrets.entropy_hits(view(spark, d, "secret_lines"))
    return out.select("repo_id", "path", "line", "kind", "severity")


@query(
    "entropy_hits_documents",
    f"WITH {_DOC_LINES}, {_tokens('dl')} SELECT DISTINCT repo_id, path, line, 'generic_high_entropy' AS kind FROM ve WHERE h >= 3.5 AND NOT {_TEMPLATE} AND {_SHAPE} IS NULL",
)
def entropy_hits_documents(spark, d):
    files = view(spark, d, "doc_files").select("repo_id", "path", "content")
    lines = admission.explode_lines(files, keep=F.col("content").rlike(secrets.token_pattern()))
    return secrets.entropy_hits(lines, floor=3.5).select("repo_id", "path", "line", "kind")


@query(
    "secret_findings",
    f"WITH {_tokens('secret_lines')}, h AS ({_PATTERN_SQL} UNION ALL {_ENTROPY_SQL}) SELECT DISTINCT repo_id, 'secret-' || kind || '-' || CAST(line AS VARCHAR) || '-' || {S.slug('path')} AS id, {S.severity_for('path', 'severity')} AS severity, path AS file, line FROM h",
)
def secret_findings(spark, d):
    out = secrets.secret_findings(secrets.scan_lines(view(spark, d, "secret_lines")))
    first = F.get("evidence", F.lit(0))
    return out.select("repo_id", "id", "severity", first["file"].alias("file"), first["line"].alias("line"))


_LISTED = "wl AS (SELECT word FROM wordlist)"


@query(
    "wordlist_files",
    f"WITH {_LISTED}, t AS (SELECT repo_id, path, unnest(regexp_extract_all(lower(text), '[a-z]{{3,12}}')) AS w FROM name_lines) SELECT repo_id, path, count(*) AS words, round(avg(CASE WHEN word IS NULL THEN 0 ELSE 1 END), 6) AS known_share FROM t LEFT JOIN wl ON word = w GROUP BY 1, 2 HAVING count(*) >= 8 AND avg(CASE WHEN word IS NULL THEN 0 ELSE 1 END) >= 0.75",
)
def wordlist_files(spark, d):
    lines = view(spark, d, "name_lines")
    files = lines.select("repo_id", "path", F.col("text").alias("content"))
    out = secrets.wordlist_files(files, view(spark, d, "wordlist"), min_words=8)
    return out.select("repo_id", "path", "words", F.round("known_share", 6).alias("known_share"))


@query(
    "mnemonic_hits",
    f"""WITH {_LISTED}, a AS (SELECT repo_id, path, list_filter(string_split_regex(lower(text), '[\\s,]+'), LAMBDA w: w <> '') AS ws FROM name_lines),
e AS (SELECT repo_id, path, ws[i] AS w, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM a)),
k AS (SELECT repo_id, path, i, i - row_number() OVER (PARTITION BY repo_id, path ORDER BY i) AS g FROM e JOIN wl ON word = w),
r AS (SELECT repo_id, path, g, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT repo_id, path, max(n) AS n FROM r GROUP BY ALL)
SELECT repo_id, path, CAST(1 AS INT) AS line, 'mnemonic' AS kind, CAST(CASE WHEN n >= 24 THEN 24 WHEN n >= 21 THEN 21 WHEN n >= 18 THEN 18 WHEN n >= 15 THEN 15 ELSE 12 END AS INT) AS words FROM m WHERE n >= 12""",
)
def mnemonic_hits(spark, d):
    out = secrets.mnemonic_hits(view(spark, d, "name_lines"), view(spark, d, "wordlist"))
    words = F.regexp_extract("reason", r"of (\d+) words", 1).cast("int")
    return out.select("repo_id", "path", "line", "kind", words.alias("words"))


# --- history -----------------------------------------------------------------------------------
_PATCH = """sp AS (SELECT repo_id, sha, subject, filename, seq, string_split(patch, chr(10)) AS a FROM commit_files),
pr AS (SELECT repo_id, sha, subject, filename, seq, i, a[i] AS r FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM sp)),
ph AS (SELECT *, regexp_extract(r, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1) AS hs FROM pr),
pg AS (SELECT *, sum(CASE WHEN hs <> '' THEN 1 ELSE 0 END) OVER w AS hunk FROM ph WINDOW w AS (PARTITION BY repo_id, sha, filename ORDER BY i ROWS UNBOUNDED PRECEDING)),
pc AS (SELECT *, max(CASE WHEN hs <> '' THEN CAST(hs AS INT) END) OVER (PARTITION BY repo_id, sha, filename, hunk) AS st,
  sum(CASE WHEN hs <> '' OR starts_with(r, '+++') OR starts_with(r, '-') OR starts_with(r, '\\') THEN 0 ELSE 1 END) OVER (PARTITION BY repo_id, sha, filename, hunk ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM pg),
pl AS (SELECT repo_id, sha, subject, filename AS path, seq, CAST(coalesce(st, 0) + k - 1 AS INT) AS line, substr(r, 2) AS text FROM pc WHERE starts_with(r, '+') AND NOT starts_with(r, '+++') AND hs = '')""".replace("\\\\", "\\")


@query("patch_added_lines", f"WITH {_PATCH} SELECT repo_id, sha, path, line, md5(text) AS text_md5 FROM pl")
def patch_added_lines(spark, d):
    out = history.patch_added_lines(view(spark, d, "commit_files"))
    return out.select("repo_id", "sha", F.col("filename").alias("path"), "line", F.md5("text").alias("text_md5"))


def _commits(spark, d):
    return view(spark, d, "commit_files").withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600)).drop("seq")


_HIST = f"""{_PATCH}, {_tokens('pl').replace('SELECT repo_id, path, line, regexp_replace', 'SELECT repo_id, path, line, sha, subject, seq, regexp_replace').replace('SELECT repo_id, path, line, text, CASE', 'SELECT repo_id, path, line, sha, subject, seq, text, CASE')},
hh AS (SELECT repo_id, path AS file, sha, seq, line FROM ve WHERE h >= 3.5 AND NOT {_TEMPLATE} AND {_SHAPE} IS NULL),
hf AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY seq, sha, line) AS n FROM hh)"""


@query(
    "history_secret_hits",
    f"WITH {_HIST} SELECT repo_id, 'generic_high_entropy' AS kind, file, sha, line, {S.severity_for('file', S.q('medium'))} AS severity FROM hf WHERE n = 1",
)
def history_secret_hits(spark, d):
    out = history.history_secret_hits(_commits(spark, d), floor=3.5)
    return out.select("repo_id", "kind", "file", "sha", "line", "severity")


@query(
    "history_findings",
    f"WITH {_HIST} SELECT repo_id, 'secret-history-generic_high_entropy-' || substr(sha, 1, 7) || '-' || {S.slug('file')} AS id, file, line FROM hf WHERE n = 1",
)
def history_findings(spark, d):
    out = history.history_findings(history.history_secret_hits(_commits(spark, d), floor=3.5))
    first = F.get("evidence", F.lit(0))
    return out.select("repo_id", "id", first["file"].alias("file"), first["line"].alias("line"))


@query(
    "history_scope",
    "WITH n AS (SELECT repo_id, count(DISTINCT sha) AS n FROM commit_files GROUP BY 1), r AS (SELECT DISTINCT source AS repo_id FROM documents) SELECT r.repo_id, CAST(NULL AS INT) AS requested, CAST(n AS INT) AS scanned, n > 0 AS complete FROM r JOIN n ON n.repo_id = r.repo_id",
)
def history_scope(spark, d):
    commits = _commits(spark, d)
    return history.history_scope(commits.select("repo_id").distinct(), commits).drop("note")


@query(
    "recent_commits",
    "SELECT DISTINCT repo_id, sha FROM commit_files",
)
def recent_commits(spark, d):
    return history.recent_commits(_commits(spark, d)).select("repo_id", "sha")
