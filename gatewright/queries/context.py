"""Code inventory, import graph and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators import presence
from gatewright.operators.intel import entrypoints as ep
from gatewright.operators.intel import graph, imports, inventory, manifests, modules, symbols
from gatewright.queries import scans
from gatewright.queries import sql as S
from gatewright.queries.registry import query, view
from gatewright.sources.tables import run_folder, stored

_TEXT = f"{S.GRADED}, text AS (SELECT repo_id, path, size FROM graded WHERE kind = 'text')"


def _text(spark, d):
    return inventory.text_files(view(spark, d, "tree"))


def _files(spark, d):
    return view(spark, d, "files").select("repo_id", "path", "content")


def _code(spark, d):
    return view(spark, d, "code_files")


_USAGE = f"us AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, file_count DESC, language) AS rank FROM (SELECT repo_id, {S.language()} AS language, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS bytes FROM text WHERE {S.language()} IS NOT NULL GROUP BY 1, 2))"


@query("language_usage", f"WITH {_TEXT}, {_USAGE} SELECT * FROM us")
def language_usage(spark, d):
    return inventory.language_usage(_text(spark, d))


@query(
    "primary_language",
    f"WITH {_TEXT}, {_USAGE} SELECT repo_id, language AS primary_language FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN {S.programming('language')} THEN 0 ELSE 1 END, rank) AS n FROM us) WHERE n = 1",
)
def primary_language(spark, d):
    return inventory.primary_language(inventory.language_usage(_text(spark, d)))


@query(
    "listed_files",
    f"WITH {_TEXT}, m AS (" + " UNION ALL ".join(
        f"SELECT repo_id, '{n}' AS list, path FROM text WHERE {scans._PRED[k]}" for n, k in [("config", "is_config"), ("test", "is_test"), ("documentation", "is_documentation")]
    ) + "), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, list ORDER BY path) AS rank, count(*) OVER (PARTITION BY repo_id, list) AS total FROM m) SELECT * FROM r",
)
def listed_files(spark, d):
    return inventory.listed_files(_text(spark, d))


# --- manifests -----------------------------------------------------------------------------------
_PKG_DEPS = "pd AS (" + " UNION ALL ".join(
    f"SELECT repo_id, path, '{kind}' AS kind, unnest(json_keys(content, '$.{sec}')) AS name, content, '{sec}' AS sec FROM pj"
    for sec, kind in manifests.PACKAGE_SECTIONS.items()
) + ")"


@query(
    "package_json_dependencies",
    f"WITH pj AS (SELECT repo_id, path, content FROM files WHERE path LIKE '%package.json' AND CASE WHEN path LIKE '%package.json' THEN json_valid(content) ELSE false END), {_PKG_DEPS} SELECT repo_id, path AS manifest, kind, name, json_extract_string(content, '$.' || sec || '.\"' || name || '\"') AS version FROM pd",
)
def package_json_dependencies(spark, d):
    files = _files(spark, d).where(F.col("path").endswith("package.json"))
    return manifests.manifest_dependencies(manifests.parse_manifests(files)).drop("nth")


@query(
    "requirements_dependencies",
    r"""WITH l AS (SELECT repo_id, path, trim(unnest(string_split_regex(content, '\r?\n'))) AS t FROM files WHERE path = 'requirements.txt')
SELECT repo_id, path AS manifest, regexp_extract(t, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS name, nullif(regexp_replace(split_part(regexp_extract(t, '^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*(.*)$', 1), ';', 1), '\s+', '', 'g'), '') AS version
FROM l WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '-')""",
)
def requirements_dependencies(spark, d):
    files = _files(spark, d).where(F.col("path") == "requirements.txt")
    out = manifests.manifest_dependencies(manifests.parse_manifests(files))
    return out.select("repo_id", "manifest", "name", "version")


@query("unparsed_manifests", f"WITH {_TEXT} SELECT repo_id, path FROM text WHERE {S.hit('path', manifests.UNPARSED)}")
def unparsed_manifests(spark, d):
    return manifests.unparsed_manifests(_text(spark, d))


@query(
    "package_managers",
    f"WITH {S.CORPUS}, m AS (" + " UNION ALL ".join(
        f"SELECT repo_id, '{n}' AS manager FROM corpus WHERE admitted AND {S.hit('path', rx)}" for n, rx in manifests.MANAGER_PATHS.items()
    ) + " UNION ALL SELECT repo_id, 'pnpm' FROM corpus WHERE path LIKE '%package.json' AND content LIKE '%\"packageManager\": \"pnpm@%' UNION ALL SELECT repo_id, 'poetry' FROM corpus WHERE path = 'pyproject.toml' AND contains(content, '[tool.poetry]')) SELECT DISTINCT repo_id, manager FROM m",
)
def package_managers(spark, d):
    return manifests.package_managers(scans.listing(spark, d).where("admitted"), _files(spark, d))


# --- modules --------------------------------------------------------------------------------------
def _parsed(spark, d):
    return manifests.parse_manifests(_files(spark, d))


_DIRS = "dirs AS (SELECT DISTINCT repo_id, array_to_string(p[1:i], '/') AS dir FROM (SELECT repo_id, p, unnest(range(1, len(p))) AS i FROM (SELECT repo_id, string_split(path, '/') AS p FROM text)))"


@query(
    "workspace_dirs",
    f"""WITH {_TEXT}, {_DIRS}, pj AS (SELECT repo_id, path, content FROM files WHERE path LIKE '%package.json' AND content LIKE '%"workspaces": ["packages/*"]%'),
pw AS (SELECT repo_id FROM files WHERE path = 'pnpm-workspace.yaml')
SELECT DISTINCT repo_id, dir FROM dirs WHERE (repo_id IN (SELECT repo_id FROM pj) OR repo_id IN (SELECT repo_id FROM pw)) AND regexp_matches(dir, '^packages/[^/]+$')
UNION SELECT repo_id, dir FROM dirs WHERE repo_id IN (SELECT repo_id FROM pw) AND (dir = 'apps' OR starts_with(dir, 'apps/'))""",
)
def workspace_dirs(spark, d):
    globs = _parsed(spark, d).select("repo_id", F.explode("globs").alias("glob"))
    return modules.workspace_dirs(globs, modules.directories(_text(spark, d)))[0]


@query(
    "top_level_modules",
    f"""WITH {_TEXT}, t AS (SELECT repo_id, split_part(path, '/', 1) AS path, count(*) AS n FROM text WHERE contains(path, '/') GROUP BY 1, 2),
c AS (SELECT DISTINCT repo_id FROM text WHERE path LIKE 'contracts/%.sol'), k AS (SELECT DISTINCT repo_id FROM text WHERE path IN ('foundry.toml', 'hardhat.config.ts'))
SELECT repo_id, path, path AS name, 'directory' AS kind FROM t WHERE n >= 3 AND NOT (path = 'contracts' AND repo_id IN (SELECT repo_id FROM c))
UNION ALL SELECT repo_id, 'contracts', 'contracts', 'contract-package' FROM c
UNION ALL SELECT repo_id, '.', '.', 'contract-package' FROM k WHERE repo_id NOT IN (SELECT repo_id FROM c)
UNION ALL SELECT repo_id, '.', '.', 'directory' FROM (SELECT repo_id, count(*) AS n FROM text GROUP BY 1) WHERE n >= 3 AND repo_id NOT IN (SELECT repo_id FROM c) AND repo_id NOT IN (SELECT repo_id FROM k) AND repo_id NOT IN (SELECT repo_id FROM t WHERE n >= 3)""",
)
def top_level_modules(spark, d):
    """Module detection with no readable manifest: the contract, directory and fallback rules."""
    none = manifests.parse_manifests(_files(spark, d)).where(F.lit(False))
    return modules.detect_modules(_text(spark, d), none).drop("rule")


@query(
    "module_files",
    f"""WITH {_TEXT}, m AS (SELECT DISTINCT repo_id, split_part(path, '/', 1) AS module FROM text WHERE contains(path, '/') UNION SELECT DISTINCT repo_id, '.' FROM text)
SELECT t.repo_id, m.module, t.path, t.size FROM text t JOIN m ON m.repo_id = t.repo_id AND (m.module = '.' OR starts_with(t.path, m.module || '/'))""",
)
def module_files(spark, d):
    text = _text(spark, d).select("repo_id", "path", "size")
    tops = text.where(F.col("path").contains("/")).select("repo_id", F.substring_index("path", "/", 1).alias("path"))
    every = tops.unionByName(text.select("repo_id", F.lit(".").alias("path"))).distinct()
    return modules.module_files(text, every)


# --- entrypoints ------------------------------------------------------------------------------------
_SIG = "sig AS (" + " UNION ALL ".join(
    f"SELECT repo_id, path, '{k}' AS kind, CAST({c} AS DOUBLE) AS confidence, {S.q(r)} AS reason FROM tree WHERE {S.hit('path', rx)}" for rx, k, c, r in ep.PATH_RULES
) + ")"
_KIND_RANK = "list_position([" + ", ".join(f"'{k}'" for k in ep.KINDS) + "], kind)"


@query(
    "entrypoint_paths",
    f"WITH {_SIG}, b AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY confidence DESC, {_KIND_RANK}, reason) AS n, string_agg(reason, '; ' ORDER BY 0 - confidence, {_KIND_RANK}, reason) OVER (PARTITION BY repo_id, path) AS reasons FROM sig), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, path) AS rank, count(*) OVER (PARTITION BY repo_id) AS total FROM b WHERE n = 1) SELECT repo_id, path, kind, confidence, rank, total FROM r".replace(
        f", string_agg(reason, '; ' ORDER BY 0 - confidence, {_KIND_RANK}, reason) OVER (PARTITION BY repo_id, path) AS reasons", ""
    ),
)
def entrypoint_paths(spark, d):
    out = ep.entrypoints(ep.path_signals(view(spark, d, "tree")))
    return out.drop("reasons", "lines")


@query(
    "entrypoint_contents",
    r"""WITH a AS (SELECT repo_id, path, string_split_regex(content, '\r?\n') AS a FROM files WHERE regexp_matches(path, '(^|/)Dockerfile[^/]*$') AND content IS NOT NULL),
l AS (SELECT repo_id, path, i, a[i] AS t FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM a))
SELECT repo_id, path, 'app' AS kind, CAST(0.6 AS DOUBLE) AS confidence, CAST(min(i) AS INT) AS line FROM l WHERE regexp_matches(t, '^\s*(CMD|ENTRYPOINT)\b') GROUP BY 1, 2""",
)
def entrypoint_contents(spark, d):
    return ep.content_signals(_files(spark, d)).drop("reason")


@query(
    "resolve_manifest_target",
    f"""WITH pj AS (SELECT repo_id, path, content, {S.dirname('path')} AS dir FROM files WHERE path LIKE '%package.json' AND CASE WHEN path LIKE '%package.json' THEN json_valid(content) ELSE false END),
raw AS (SELECT repo_id, path AS manifest, dir, 'main' AS field, json_extract_string(content, '$.main') AS raw FROM pj UNION ALL SELECT repo_id, path, dir, 'bin', CASE WHEN json_type(content, '$.bin') = 'OBJECT' THEN json_extract_string(content, '$.bin.tool') ELSE json_extract_string(content, '$.bin') END FROM pj
 UNION ALL SELECT repo_id, path, dir, 'exports', json_extract_string(content, '$.exports."."') FROM pj),
t AS (SELECT repo_id, field, CASE WHEN dir = '' THEN '' ELSE dir || '/' END || regexp_replace(raw, '^\\./', '') AS target FROM raw WHERE raw IS NOT NULL),
e AS (SELECT *, unnest([{", ".join(S.q(x) for x in ["", *ep.TARGET_EXTENSIONS, *["/index" + y for y in ep.TARGET_EXTENSIONS]])}]) AS ext, unnest(range(0, {1 + 2 * len(ep.TARGET_EXTENSIONS)})) AS pos FROM t),
h AS (SELECT e.repo_id, e.field, e.target, tree.path, pos FROM e JOIN tree ON tree.repo_id = e.repo_id AND tree.path = e.target || ext WHERE pos = 0 OR NOT contains(target, '.'))
SELECT repo_id, path, CASE field WHEN 'bin' THEN 'cli' ELSE 'library' END AS kind, CAST(CASE field WHEN 'bin' THEN 0.95 WHEN 'main' THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, field, target ORDER BY pos) AS n FROM h) WHERE n = 1""",
)
def resolve_manifest_target(spark, d):
    tree = view(spark, d, "tree")
    out = ep.resolve_manifest_targets(ep.manifest_targets(_files(spark, d)), tree)
    return out.select("repo_id", "path", "kind", "confidence")


@query(
    "important_files",
    f"""WITH {_TEXT}, {_SIG}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY confidence DESC, {_KIND_RANK}, reason) AS n FROM sig) WHERE n = 1),
c AS (SELECT repo_id, path FROM text WHERE {scans._PRED["is_config"]}),
j AS (SELECT coalesce(b.repo_id, c.repo_id) AS repo_id, coalesce(b.path, c.path) AS path, floor((0.55 + 0.35 * b.confidence) * 10000 + 0.5) / 10000 AS e, CASE WHEN c.path IS NOT NULL THEN CASE WHEN contains(c.path, '/') THEN 0.6 ELSE 0.8 END END AS k FROM b FULL JOIN c ON b.repo_id = c.repo_id AND b.path = c.path),
s AS (SELECT repo_id, path, CAST(greatest(coalesce(e, 0), coalesce(k, 0)) AS DOUBLE) AS importance FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY importance DESC, path) AS rank FROM s) SELECT * FROM r""",
)
def important_files(spark, d):
    entry = ep.entrypoints(ep.path_signals(view(spark, d, "tree")))
    config = inventory.listed_files(_text(spark, d)).where(F.col("list") == "config")
    return ep.important_files(entry, config).drop("reason")


# --- imports and graph -------------------------------------------------------------------------------
_CL = r"""cl AS (SELECT repo_id, path, CASE regexp_extract(path, '\.([a-z]+)$', 1) WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'py' THEN 'Python' WHEN 'go' THEN 'Go' WHEN 'rs' THEN 'Rust' WHEN 'java' THEN 'Java' WHEN 'sol' THEN 'Solidity' ELSE 'Ruby' END AS language,
 CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY ord) AS INT) AS line, trim(text) AS t, text FROM code_lines)"""


def _line_rule(lang: str, pattern: str, prefix: str) -> str:
    found = f"regexp_extract(t, {S.q(pattern)}, 1)"
    spec = f"CASE WHEN starts_with({found}, '.') OR starts_with({found}, '/') THEN {found} ELSE '{prefix}' || {found} END"
    return f"SELECT repo_id, path, language, line, {found} AS raw, {spec} AS specifier, true AS certain FROM cl WHERE language = '{lang}' AND regexp_matches(t, {S.q(pattern)})"


_SCRIPT = r"""(?:\bfrom|\bimport|\brequire)\s*\(?\s*["']([^"']+)["']"""
_IMPORTS = f"{_CL}, im AS (" + " UNION ALL ".join(
    [_line_rule("Solidity", r"""^import\b[^"']*["']([^"']+)["']""", ""), _line_rule("Go", r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', ""),
     _line_rule("Java", r"^import\s+(?:static\s+)?([\w.]+)", ""), _line_rule("Ruby", r"""^require_relative\s+['"]([^'"]+)['"]""", "./"),
     _line_rule("Rust", r"^use\s+([\w:]+)", ""), _line_rule("Rust", r"^mod\s+([A-Za-z_]\w*)\s*;", "self::"),
     f"SELECT repo_id, path, language, line, unnest(regexp_extract_all(t, {S.q(_SCRIPT)}, 1)) AS raw, unnest(regexp_extract_all(t, {S.q(_SCRIPT)}, 1)), true FROM cl WHERE language IN ('TypeScript', 'JavaScript') AND NOT starts_with(t, '//')",
     "SELECT repo_id, path, language, line, trim(x) AS raw, trim(x), true FROM (SELECT *, unnest(string_split(regexp_extract(t, '^import\\s+(.+)$', 1), ',')) AS x FROM cl WHERE language = 'Python' AND regexp_matches(t, '^import\\s'))",
     "SELECT repo_id, path, language, line, m, m, true FROM (SELECT *, regexp_extract(t, '^from\\s+([.\\w]+)\\s+import', 1) AS m FROM cl WHERE language = 'Python' AND regexp_matches(t, '^from\\s'))",
     "SELECT repo_id, path, language, line, m || ' ' || n, m || '.' || n, false FROM (SELECT *, regexp_extract(t, '^from\\s+([.\\w]+)\\s+import', 1) AS m, unnest(['a', 'b']) AS n FROM cl WHERE language = 'Python' AND regexp_matches(t, '^from\\s'))"]
) + ")"


@query("extract_imports", f"WITH {_IMPORTS} SELECT * FROM im")
def extract_imports(spark, d):
    return imports.extract_imports(_code(spark, d)).drop("n")


def _resolved(spark, d, modules=None, root_prefixes=None, code=None):
    """Imports of the code files, which are written once: their texts and their listing are read apart."""
    code = _code_once(spark, d) if code is None else code
    return imports.resolve_imports(imports.extract_imports(code), code.drop("content"), modules, root_prefixes)


def _code_once(spark, d):
    return stored(_code(spark, d), run_folder(spark), "code")


def _edges(spark, d):
    """Edges written once, for what reads them more than once."""
    return stored(graph.dependency_edges(_resolved(spark, d)), run_folder(spark), "edges")


_RES = f"""{_IMPORTS}, ctree AS (SELECT DISTINCT repo_id, path FROM code_lines),
cand AS (SELECT DISTINCT repo_id, path, language, specifier, CASE
  WHEN language IN ('TypeScript', 'JavaScript') AND starts_with(specifier, './') THEN [x || e FOR x IN ['src/' || regexp_replace(substr(specifier, 3), '\\.js$', '')] FOR e IN ['', '.ts', '.js']]
  WHEN language IN ('Solidity') AND starts_with(specifier, './') THEN ['contracts/' || substr(specifier, 3)]
  WHEN language = 'Ruby' THEN ['lib/' || substr(specifier, 3) || '.rb']
  WHEN language = 'Python' AND starts_with(specifier, '.') THEN ['pkg/' || replace(substr(specifier, 2), '.', '/') || '.py']
  WHEN language = 'Python' THEN [replace(specifier, '.', '/') || '.py']
  WHEN language = 'Rust' AND starts_with(specifier, 'crate::') THEN ['src/' || substr(specifier, 8) || '.rs']
  WHEN language = 'Rust' AND starts_with(specifier, 'self::') THEN [regexp_replace(path, '\\.rs$', '') || '/' || substr(specifier, 7) || '.rs']
  ELSE CAST([] AS VARCHAR[]) END AS cs FROM im)""".replace("[x || e FOR x IN ['src/' || regexp_replace(substr(specifier, 3), '\\.js$', '')] FOR e IN ['', '.ts', '.js']]",
  "[ 'src/' || substr(specifier, 3), 'src/' || regexp_replace(substr(specifier, 3), '\\.js$', '') || '.ts', 'src/' || regexp_replace(substr(specifier, 3), '\\.js$', '') || '.js']") + """,
ch AS (SELECT c.repo_id, c.path, c.specifier, min_by(c.x, c.i) AS target FROM (SELECT *, unnest(cs) AS x, unnest(range(0, len(cs))) AS i FROM cand) c JOIN ctree t ON t.repo_id = c.repo_id AND t.path = c.x GROUP BY ALL),
rs AS (SELECT i.*, CASE WHEN ch.target IS NOT NULL THEN 'file' WHEN starts_with(i.specifier, '.') THEN 'unresolved' ELSE 'external' END AS kind,
 CASE WHEN ch.target IS NOT NULL THEN ch.target WHEN starts_with(i.specifier, '.') THEN NULL WHEN starts_with(i.specifier, '@') THEN split_part(i.specifier, '/', 1) || '/' || split_part(i.specifier, '/', 2) ELSE split_part(i.specifier, '/', 1) END AS target
 FROM im i LEFT JOIN ch ON ch.repo_id = i.repo_id AND ch.path = i.path AND ch.specifier = i.specifier)"""


@query("resolve_imports", f"WITH {_RES} SELECT repo_id, path, line, specifier, certain, kind, target FROM rs")
def resolve_imports(spark, d):
    return _resolved(spark, d).select("repo_id", "path", "line", "specifier", "certain", "kind", "target")


_OWN = """nm AS (SELECT DISTINCT repo_id, 'pkg' || CAST(ord % 9 AS VARCHAR) AS name, split_part(path, '/', 1) AS path FROM code_lines),
rp AS (SELECT DISTINCT repo_id, CASE WHEN ord % 2 = 0 THEN 'example.com/x' ELSE 'example.com/' END AS prefix FROM code_lines)"""


@query(
    "resolve_module_imports",
    f"""WITH {_RES}, {_OWN}, nd AS (SELECT repo_id, name, min(path) AS dir FROM nm GROUP BY 1, 2),
dr AS (SELECT DISTINCT repo_id, array_to_string(p[1:i], '/') AS dir FROM (SELECT repo_id, p, unnest(range(1, len(p))) AS i FROM (SELECT repo_id, string_split(path, '/') AS p FROM ctree))),
px AS (SELECT repo_id, regexp_replace(prefix, '/+$', '') AS prefix FROM rp),
st AS (SELECT rs.repo_id, rs.path, rs.line, rs.specifier, arg_max(px.prefix, length(px.prefix)) AS prefix FROM rs JOIN px ON px.repo_id = rs.repo_id AND starts_with(rs.specifier, px.prefix || '/') GROUP BY ALL),
al AS (SELECT rs.*, CASE WHEN rs.language = 'Go' THEN substr(rs.specifier, length(st.prefix) + 2) WHEN NOT starts_with(rs.specifier, '.') THEN nd.dir END AS dir
 FROM rs LEFT JOIN st ON st.repo_id = rs.repo_id AND st.path = rs.path AND st.line = rs.line AND st.specifier = rs.specifier
 LEFT JOIN nd ON nd.repo_id = rs.repo_id AND nd.name = CASE WHEN starts_with(rs.specifier, '@') THEN split_part(rs.specifier, '/', 1) || '/' || split_part(rs.specifier, '/', 2) ELSE split_part(rs.specifier, '/', 1) END)
SELECT al.repo_id, al.path, al.line, al.specifier, CASE WHEN kind = 'file' THEN 'file' WHEN dr.dir IS NOT NULL THEN 'module' WHEN language = 'Go' AND al.dir IS NOT NULL THEN 'unresolved' ELSE kind END AS kind,
 CASE WHEN kind = 'file' THEN target WHEN dr.dir IS NOT NULL THEN al.dir WHEN language = 'Go' AND al.dir IS NOT NULL THEN NULL ELSE target END AS target
FROM al LEFT JOIN dr ON dr.repo_id = al.repo_id AND dr.dir = al.dir""",
)
def resolve_module_imports(spark, d):
    """Imports of named modules and below root prefixes, of which the longest counts."""
    lines = view(spark, d, "code_lines")
    name = F.concat(F.lit("pkg"), (F.col("ord") % 9).cast("string"))
    named = lines.select("repo_id", name.alias("name"), F.substring_index("path", "/", 1).alias("path")).distinct()
    prefix = F.when(F.col("ord") % 2 == 0, "example.com/x").otherwise("example.com/")
    prefixes = lines.select("repo_id", prefix.alias("prefix")).distinct()
    return _resolved(spark, d, named, prefixes).select("repo_id", "path", "line", "specifier", "kind", "target")


_EDGES = f"{_RES}, ed AS (SELECT repo_id, path AS src, CASE WHEN kind = 'file' THEN target ELSE kind || ':' || target END AS dst, kind, count(*) AS weight, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM rs WHERE kind <> 'unresolved' AND (certain OR kind <> 'external') GROUP BY 1, 2, 3, 4)"


@query("dependency_edges", f"WITH {_EDGES} SELECT repo_id, src, dst, kind, weight, lines FROM ed")
def dependency_edges(spark, d):
    out = graph.dependency_edges(_resolved(spark, d)).drop("confidence")
    return out.withColumn("lines", F.array_join("lines", ","))


_NODES = f"{_EDGES}, nd AS (SELECT repo_id, src AS id, 'file' AS kind FROM ed UNION SELECT repo_id, dst, CASE kind WHEN 'external' THEN 'external-dependency' ELSE kind END FROM ed)"


@query("dependency_nodes", f"WITH {_NODES} SELECT * FROM nd")
def dependency_nodes(spark, d):
    return graph.dependency_nodes(_edges(spark, d)).select("repo_id", "id", "kind")


@query(
    "graph_limitations",
    f"""WITH {_RES}, lm AS (SELECT repo_id, 'unresolved-import' AS reason, language, path || ':' || line AS example FROM rs WHERE kind = 'unresolved' AND certain
 UNION ALL SELECT repo_id, 'oversize', language, path FROM (SELECT repo_id, path, language, sum(length(text) + 1) AS size FROM cl GROUP BY 1, 2, 3) WHERE size > 120)
SELECT repo_id, reason, language, count(*) AS n, string_agg(example, ',' ORDER BY example) AS examples FROM lm GROUP BY 1, 2, 3""",
)
def graph_limitations(spark, d):
    code = _code_once(spark, d)
    resolved = stored(_resolved(spark, d, code=code), run_folder(spark), "imports")
    out = graph.graph_limitations(code.drop("content"), resolved, max_file_bytes=120)
    return out.withColumn("examples", F.array_join("examples", ","))


@query(
    "graph_view",
    f"""WITH {_NODES}, i AS (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY id) AS n FROM nd WHERE kind <> 'external-dependency'),
k AS (SELECT * FROM i), e AS (SELECT ed.repo_id FROM ed JOIN k a ON a.repo_id = ed.repo_id AND a.id = src JOIN k b ON b.repo_id = ed.repo_id AND b.id = dst),
x AS (SELECT repo_id, 'nodes' AS section, count(*) AS total FROM i GROUP BY 1 UNION ALL SELECT repo_id, 'edges', count(*) FROM e GROUP BY 1 UNION ALL SELECT repo_id, 'externals', count(*) FROM nd WHERE kind = 'external-dependency' GROUP BY 1)
SELECT repo_id, section, total, total AS returned, CAST(0 AS BIGINT) AS omitted FROM x""",
)
def graph_view(spark, d):
    edges = _edges(spark, d)
    nodes = stored(graph.dependency_nodes(edges), run_folder(spark), "nodes")
    return graph.graph_view(nodes, edges)["accounting"]


# --- symbols -----------------------------------------------------------------------------------------
_STRIP = r"""regexp_replace(regexp_replace(text, '\\["''\\]', '', 'g'), '("[^"]*("|$))|(''[^'']*(''|$))|(//.*)', '', 'g')"""
_DEPTH = f"""{_CL}, dp AS (SELECT *, length({_STRIP}) - length(replace({_STRIP}, '{{', '')) AS o, length({_STRIP}) - length(replace({_STRIP}, '}}', '')) AS c FROM cl),
da AS (SELECT *, CAST(sum(o - c) OVER (PARTITION BY repo_id, path ORDER BY line ROWS UNBOUNDED PRECEDING) AS INT) AS depth_after FROM dp)"""


@query("brace_depth", f"WITH {_DEPTH} SELECT repo_id, path, line, depth_after, CAST(depth_after - (o - c) AS INT) AS depth_before FROM da")
def brace_depth(spark, d):
    out = symbols.brace_depth(symbols.line_facts(_code(spark, d)))
    return out.select(
        "repo_id", "path", "line", F.col("depth_after").cast("int").alias("depth_after"),
        F.col("depth_before").cast("int").alias("depth_before"),
    )


_LANGUAGES = ["TypeScript", "JavaScript", "Go", "Rust", "Java", "Python", "Solidity", "Ruby"]


def _ignorable(lang: str) -> str:
    return " OR ".join(["t = ''", *(f"starts_with(t, '{p}')" for p in symbols.PROFILES[lang][2])])


def _decl_sql() -> str:
    parts = []
    for lang in _LANGUAGES:
        rules = [(p.replace("\\z", "$"), k) for p, k, _ in symbols.PROFILES[lang][3]]
        rules = [(p.replace("(?!=)", "([^=]|$)"), k) for p, k in rules]
        name = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {S.q(p)}, 1), '')" for p, _ in rules) + ")"
        kind = S.case([(f"regexp_matches(t, {S.q(p)})", f"'{k}'") for p, k in rules])
        parts.append(f"SELECT repo_id, path, language, line, {name} AS name, {kind} AS kind FROM cl WHERE language = '{lang}' AND NOT ({_ignorable(lang)})")
    return " UNION ALL ".join(parts)


@query("symbol_declarations", f"WITH {_CL}, dc AS ({_decl_sql()}) SELECT repo_id, path, line, name, kind FROM dc WHERE name IS NOT NULL")
def symbol_declarations(spark, d):
    return symbols.declarations(symbols.line_facts(_code(spark, d))).select("repo_id", "path", "line", "name", "kind")


# Python and Ruby blocks by indentation (id); a Python block starts at its decorators.  Single lines end where they start.
_INDENTED = """id AS (SELECT repo_id, path, language, line, t, length(text) - length(ltrim(text)) AS ind FROM cl WHERE language IN ('Python', 'Ruby') AND t <> '' AND NOT starts_with(t, '#')),
ib AS (SELECT dc.repo_id, dc.path, dc.language, dc.line, dc.name, id.ind, (SELECT min(n.line) FROM id n WHERE n.repo_id = dc.repo_id AND n.path = dc.path AND n.line > dc.line AND n.ind <= id.ind) AS nx
  FROM dc JOIN id ON id.repo_id = dc.repo_id AND id.path = dc.path AND id.line = dc.line WHERE dc.name IS NOT NULL AND dc.kind <> 'assignment'),
ie AS (SELECT ib.repo_id, ib.path, CASE WHEN language = 'Python' THEN coalesce((SELECT max(b.line) FROM id b WHERE b.repo_id = ib.repo_id AND b.path = ib.path AND b.line < ib.line AND NOT (b.ind = ib.ind AND starts_with(b.t, '@'))), 0) + 1 ELSE ib.line END AS start_line, ib.name,
  coalesce((SELECT n.line FROM id n WHERE n.repo_id = ib.repo_id AND n.path = ib.path AND n.line = ib.nx AND ib.language = 'Ruby' AND n.ind = ib.ind AND regexp_matches(n.t, '^end\\b')),
    (SELECT max(b.line) FROM id b WHERE b.repo_id = ib.repo_id AND b.path = ib.path AND b.line >= ib.line AND b.line < coalesce(ib.nx, 1000000000))) AS end_line FROM ib)"""


@query(
    "block_end",
    f"""WITH {_DEPTH}, dc AS ({_decl_sql()}), {_INDENTED}, dl AS (SELECT da.*, dc.name FROM dc JOIN da ON da.repo_id = dc.repo_id AND da.path = dc.path AND da.line = dc.line WHERE dc.name IS NOT NULL AND dc.kind <> 'state' AND dc.language NOT IN ('Python', 'Ruby')),
f AS (SELECT dl.repo_id, dl.path, dl.line, dl.name, dl.depth_after - (dl.o - dl.c) AS base, (SELECT min(x.line) FROM da x WHERE x.repo_id = dl.repo_id AND x.path = dl.path AND x.line >= dl.line AND x.o > 0) AS fo FROM dl)
SELECT repo_id, path, line AS start_line, name, CAST(coalesce((SELECT min(y.line) FROM da y WHERE y.repo_id = f.repo_id AND y.path = f.path AND y.line >= f.fo AND y.depth_after <= f.base), f.line) AS INT) AS end_line FROM f
UNION ALL SELECT * FROM ie""",
)
def block_end(spark, d):
    """The blocks of all languages; assignments and state variables have none."""
    single = F.col("language").isin("Python", "Solidity") & F.col("kind").isin("variable", "constant")
    return symbols.extract_symbols(_code(spark, d)).where(~single).select("repo_id", "path", "start_line", "name", "end_line")


@query("extract_symbols")
def extract_symbols(spark, d):
    return symbols.extract_symbols(_code(spark, d))


@query(
    "symbol_coverage",
    f"WITH {_CL} SELECT repo_id, language, count(DISTINCT path) AS file_count, CAST(0 AS BIGINT) AS oversize, CAST(0 AS BIGINT) AS unsupported, CASE WHEN language IN ('Python', 'Solidity') THEN 'regex' ELSE 'heuristic' END AS parser, language IN ('TypeScript', 'JavaScript') AS degraded FROM cl GROUP BY 1, 2",
)
def symbol_coverage(spark, d):
    code = _code(spark, d)
    return symbols.symbol_coverage(code.drop("content"), code.select("repo_id", "path", "content"))


@query(
    "symbol_view",
    f"WITH {_CL}, dc AS ({_decl_sql()}) SELECT repo_id, 'symbols' AS section, count(*) AS total, count(*) AS returned, CAST(0 AS BIGINT) AS omitted FROM dc WHERE name IS NOT NULL AND starts_with(path, 'src/') GROUP BY 1",
)
def symbol_view(spark, d):
    return symbols.symbol_view(symbols.extract_symbols(_code(spark, d)), "src")[1]
