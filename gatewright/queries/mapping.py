"""Manifests, modules, entrypoints and the context of whole repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators.intel import entrypoints as ep
from gatewright.operators.intel import manifests
from gatewright.plans import context as plan
from gatewright.queries import scans
from gatewright.queries import sql as S
from gatewright.queries.registry import query, view
from gatewright.sources.tables import run_folder, stored

_KIND_OF = S.case([(S.hit("path", rx), f"'{k}'") for k, rx in manifests.MANIFEST_KINDS.items()])
_KIND_ORDER = "list_position([" + ", ".join(f"'{k}'" for k in manifests.MANIFEST_KINDS) + "], kind)"
_SECTIONS = ", ".join(f"({i}, '{sec}', '{kind}')" for i, (sec, kind) in enumerate(manifests.PACKAGE_SECTIONS.items()))
_REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"


def _requirement(text: str) -> str:
    rest = f"regexp_replace(split_part(regexp_extract({text}, {S.q(_REQUIREMENT)}, 2), ';', 1), '\\s+', '', 'g')"
    return f"regexp_extract({text}, {S.q(_REQUIREMENT)}, 1) AS name, nullif({rest}, '') AS version"


# Manifests (mf) with their lines (ml), TOML entries (me), names (mn), dependencies (md) and workspace globs (mg).
def _manifests(source: str) -> str:
    return rf"""
mf AS (SELECT repo_id, path, content, kind, {_KIND_ORDER} AS priority, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir
  FROM (SELECT repo_id, path, content, {_KIND_OF} AS kind FROM {source} WHERE content IS NOT NULL) WHERE kind IS NOT NULL),
ml AS (SELECT repo_id, path, kind, i, trim(a[i]) AS raw, trim(regexp_replace(a[i], '#.*$', '')) AS t
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT repo_id, path, kind, string_split_regex(content, '\r?\n') AS a FROM mf WHERE kind <> 'package_json'))),
mh AS (SELECT *, last_value(CASE WHEN regexp_matches(t, '^\[[^\]]+\]$') THEN trim(t, '[]') END IGNORE NULLS) OVER w AS section,
  last_value(CASE WHEN regexp_matches(t, '^[A-Za-z0-9_."-]+\s*=') THEN i END IGNORE NULLS) OVER w AS entry
  FROM ml WHERE kind IN ('pyproject', 'cargo') AND t <> '' WINDOW w AS (PARTITION BY repo_id, path ORDER BY i)),
me AS (SELECT repo_id, path, kind, section, entry, regexp_extract(t, '^"?([A-Za-z0-9_.-]+)"?\s*=\s*(.*)$', 1) AS key, regexp_extract(t, '^"?([A-Za-z0-9_.-]+)"?\s*=\s*(.*)$', 2) AS value
  FROM (SELECT repo_id, path, kind, section, entry, string_agg(t, ' ' ORDER BY i) AS t FROM mh WHERE entry IS NOT NULL AND NOT regexp_matches(t, '^\[[^\]]+\]$') GROUP BY ALL)
  WHERE regexp_matches(t, '^[A-Za-z0-9_."-]+\s*=')),
mk AS (SELECT *, CASE WHEN kind = 'pyproject' THEN CASE WHEN section = 'project' AND key = 'dependencies' THEN 'runtime' WHEN section = 'project.optional-dependencies' THEN 'optional'
    WHEN section = 'build-system' AND key = 'requires' THEN 'dev' WHEN section = 'tool.poetry.dependencies' THEN 'runtime' WHEN section = 'tool.poetry.dev-dependencies' THEN 'dev' END
  ELSE CASE section WHEN 'dependencies' THEN 'runtime' WHEN 'dev-dependencies' THEN 'dev' WHEN 'build-dependencies' THEN 'dev' END END AS dep FROM me),
mp AS (SELECT repo_id, path, content, dir, priority FROM mf WHERE kind = 'package_json' AND CASE WHEN kind = 'package_json' THEN json_valid(content) ELSE false END),
mg1 AS (SELECT *, last_value(CASE WHEN g = 'require (' THEN 1 WHEN g = ')' THEN 0 END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside
  FROM (SELECT *, trim(regexp_replace(regexp_replace(raw, '//.*$', ''), '\s+', ' ', 'g')) AS g FROM ml WHERE kind = 'go_mod')),
md1 AS (
  SELECT repo_id, path, s * 100000 AS o, name, json_extract_string(content, '$.' || sec || '."' || name || '"') AS version, dep AS kind
  FROM (SELECT *, unnest(json_keys(content, '$.' || sec)) AS name FROM mp, (VALUES {_SECTIONS}) x(s, sec, dep))
  UNION ALL SELECT repo_id, path, i, {_requirement("regexp_replace(raw, '\\s+#.*$', '')")}, 'runtime' FROM ml WHERE kind = 'requirements' AND raw <> '' AND NOT starts_with(raw, '#') AND NOT starts_with(raw, '-')
  UNION ALL SELECT repo_id, path, entry * 1000 + n, {_requirement('item')}, dep FROM (SELECT *, unnest(regexp_extract_all(value, '"([^"]*)"', 1)) AS item, unnest(range(len(regexp_extract_all(value, '"([^"]*)"', 1)))) AS n FROM mk WHERE kind = 'pyproject' AND dep IS NOT NULL AND starts_with(value, '['))
  UNION ALL SELECT repo_id, path, entry * 1000, key, coalesce(nullif(regexp_extract(value, '^"([^"]*)"$', 1), ''), nullif(regexp_extract(value, '^\{{(?:.*,)?\s*version\s*=\s*"([^"]*)".*\}}$', 1), '')), dep FROM mk WHERE dep IS NOT NULL AND NOT (kind = 'pyproject' AND starts_with(value, '['))
  UNION ALL SELECT repo_id, path, CASE WHEN inside = 1 THEN i ELSE 100000 + i END, split_part(CASE WHEN inside = 1 THEN g ELSE substr(g, 9) END, ' ', 1), nullif(split_part(CASE WHEN inside = 1 THEN g ELSE substr(g, 9) END, ' ', 2), ''), 'runtime'
  FROM mg1 WHERE g <> '' AND (inside = 1 AND g <> ')' OR coalesce(inside, 0) = 0 AND starts_with(g, 'require ') AND g <> 'require (')),
md AS (SELECT repo_id, path AS manifest, CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY o, name) - 1 AS INTEGER) AS nth, name, version, kind FROM md1),
mn AS (SELECT repo_id, path, json_extract_string(content, '$.name') AS name FROM mp
  UNION ALL SELECT repo_id, path, trim(value, '"') FROM me WHERE key = 'name' AND (kind = 'pyproject' AND section = 'project' OR kind = 'cargo' AND section = 'package')
  UNION ALL SELECT repo_id, path, trim(substr(g, 8), '"') FROM mg1 WHERE starts_with(g, 'module ')),
mg AS (SELECT repo_id, unnest(CAST(json_extract(content, '$.workspaces') AS VARCHAR[])) AS pat FROM mp WHERE json_type(content, '$.workspaces') = 'ARRAY'
  UNION ALL SELECT repo_id, trim(trim(substr(raw, 2)), '"') FROM ml WHERE kind = 'pnpm_workspace' AND starts_with(raw, '-'))"""


MANIFESTS = _manifests("files")


@query("manifest_dependencies", f"WITH {MANIFESTS} SELECT * FROM md")
def manifest_dependencies(spark, d):
    return manifests.manifest_dependencies(manifests.parse_manifests(_files(spark, d)))


@query(
    "external_dependencies",
    f"""WITH {MANIFESTS}, x AS (SELECT repo_id, manifest, kind, name, arg_min(version, nth) AS version FROM md GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY manifest, name, kind) AS INTEGER) AS rank FROM x""",
)
def external_dependencies(spark, d):
    return manifests.external_dependencies(manifests.parse_manifests(_files(spark, d)))


def _files(spark, d):
    return view(spark, d, "files").select("repo_id", "path", "content")


_TEXT = f"{S.GRADED}, text AS (SELECT repo_id, path, size FROM graded WHERE kind = 'text')"
ADMITTED = f"{_TEXT}, {_manifests('(SELECT files.* FROM files JOIN text ON text.repo_id = files.repo_id AND text.path = files.path)')}"
# Modules (mo) by five rules over manifests, contracts and directories.
MODULES = f"""{ADMITTED},
dirs AS (SELECT DISTINCT repo_id, array_to_string(p[1:i], '/') AS dir FROM (SELECT repo_id, p, unnest(range(1, len(p))) AS i FROM (SELECT repo_id, string_split(path, '/') AS p FROM text))),
gl AS (SELECT DISTINCT repo_id, regexp_replace(regexp_replace(trim(pat), '^\\./', ''), '/+$', '') AS g FROM mg),
ws AS (SELECT DISTINCT dirs.repo_id, dir FROM dirs JOIN gl ON gl.repo_id = dirs.repo_id
  AND CASE WHEN g LIKE '%/**' THEN dir = left(g, length(g) - 3) OR starts_with(dir, left(g, length(g) - 2)) WHEN g LIKE '%/*' THEN {S.dirname('dir')} = left(g, length(g) - 2) ELSE dir = g END),
ow AS (SELECT * FROM (SELECT mf.repo_id, mf.dir, mf.path AS manifest, coalesce(mn.name, {S.base('mf.dir')}) AS name, row_number() OVER (PARTITION BY mf.repo_id, mf.dir ORDER BY mf.priority, mf.path) AS n
  FROM mf LEFT JOIN mn ON mn.repo_id = mf.repo_id AND mn.path = mf.path) WHERE n = 1),
tl AS (SELECT repo_id, count(*) AS files, bool_or(regexp_matches(path, '^contracts/.*\\.(sol|vy|cairo|move)$')) AS sources, bool_or(path = 'foundry.toml' OR regexp_matches(path, '^hardhat\\.config\\.[cm]?[jt]s$')) AS tool FROM text GROUP BY 1),
m3 AS (SELECT ws.repo_id, ws.dir AS path, name, 'workspace-package' AS kind, 1 AS rule FROM ws JOIN ow ON ow.repo_id = ws.repo_id AND ow.dir = ws.dir
  UNION ALL SELECT repo_id, CASE WHEN sources THEN 'contracts' ELSE '.' END, CASE WHEN sources THEN 'contracts' ELSE '.' END, 'contract-package', 2 FROM tl WHERE sources OR tool
  UNION ALL SELECT repo_id, dir, name, 'package', 3 FROM ow WHERE NOT (dir = '.' AND regexp_matches(manifest, '(^|/)pnpm-workspace\\.ya?ml$'))),
m4 AS (SELECT * FROM m3 UNION ALL SELECT t.repo_id, t.top, t.top, 'directory', 4 FROM (SELECT repo_id, split_part(path, '/', 1) AS top, count(*) AS n FROM text WHERE contains(path, '/') GROUP BY 1, 2) t
  WHERE n >= {D.MIN_MODULE_FILES} AND NOT EXISTS (SELECT 1 FROM m3 WHERE m3.repo_id = t.repo_id AND split_part(m3.path, '/', 1) = t.top)),
m5 AS (SELECT * FROM m4 UNION ALL SELECT repo_id, '.', '.', 'directory', 5 FROM tl WHERE files >= {D.MIN_MODULE_FILES} AND repo_id NOT IN (SELECT repo_id FROM m4)),
mo AS (SELECT repo_id, path, arg_min(name, rule) AS name, arg_min(kind, rule) AS kind, min(rule) AS rule FROM m5 GROUP BY 1, 2)"""

# Declared dependencies between modules (mx).
EDGES = f"""{MODULES},
dd AS (SELECT DISTINCT md.repo_id, mf.dir, md.name AS dep FROM md JOIN mf ON mf.repo_id = md.repo_id AND mf.path = md.manifest),
ha AS (SELECT DISTINCT repo_id, dir FROM mf),
mx AS (SELECT DISTINCT mo.repo_id, mo.path AS module, dd.dep AS depends_on FROM mo JOIN dd ON dd.repo_id = mo.repo_id
  AND CASE WHEN EXISTS (SELECT 1 FROM ha WHERE ha.repo_id = mo.repo_id AND ha.dir = mo.path) THEN dd.dir = mo.path ELSE mo.path <> '.' AND starts_with(dd.dir, mo.path || '/') END
  WHERE dd.dep <> mo.name AND EXISTS (SELECT 1 FROM mo o WHERE o.repo_id = mo.repo_id AND o.name = dd.dep))"""


def _map(spark, d):
    folder = run_folder(spark)
    return plan.repo_map(scans.corpus_once(spark, d, folder), folder=folder)


@query("detect_modules", f"WITH {MODULES} SELECT * FROM mo")
def detect_modules(spark, d):
    return _map(spark, d)["detected"]


@query("module_dependencies", f"WITH {EDGES} SELECT * FROM mx")
def module_dependencies(spark, d):
    return _map(spark, d)["module_edges"]


_RANK = "list_position([" + ", ".join(f"'{k}'" for k in ep.KINDS) + "], kind)"
_CONTENT = " UNION ALL ".join(
    f"SELECT repo_id, path, '{kind}' AS kind, CAST({conf} AS DOUBLE) AS confidence, {S.q(reason)} AS reason, CAST(min(i) AS INTEGER) AS line FROM el"
    f" WHERE {S.hit('path', where)} AND regexp_matches(t, {S.q(pattern.replace('(?m)', ''))})"
    + (f" AND NOT {S.hit('path', D.ENTRY_TEST_PATH)}" if kind == "contract" else "") + " GROUP BY 1, 2"
    for where, pattern, kind, conf, reason in ep.CONTENT_RULES
)
_EXTENSIONS = ", ".join(S.q(x) for x in ["", *ep.TARGET_EXTENSIONS, *["/index" + y for y in ep.TARGET_EXTENSIONS]])
# Entrypoint signals (es) of admitted files from paths, contents and manifest targets, and the best of each path (en).
ENTRIES = f"""
el AS (SELECT repo_id, path, i, a[i] AS t FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT f.repo_id, f.path, string_split_regex(f.content, '\\r?\\n') AS a
  FROM files f JOIN text ON text.repo_id = f.repo_id AND text.path = f.path WHERE f.content IS NOT NULL))),
er AS (SELECT repo_id, path, dir, 'main' AS field, 0 AS leaf, json_extract_string(content, '$.main') AS raw FROM mp
  UNION ALL SELECT repo_id, path, dir, 'bin', 0, CASE WHEN json_type(content, '$.bin') = 'OBJECT' THEN json_extract_string(content, '$.bin.tool') ELSE json_extract_string(content, '$.bin') END FROM mp
  UNION ALL SELECT repo_id, path, dir, 'exports', 0, json_extract_string(content, '$.exports."."') FROM mp),
et AS (SELECT repo_id, path, field, CASE WHEN dir = '.' THEN '' ELSE dir || '/' END || regexp_replace(raw, '^\\./', '') AS target FROM er WHERE raw IS NOT NULL),
ex AS (SELECT *, unnest([{_EXTENSIONS}]) AS ext, unnest(range(0, {1 + 2 * len(ep.TARGET_EXTENSIONS)})) AS pos FROM et),
eh AS (SELECT ex.repo_id, ex.path AS manifest, ex.field, text.path, row_number() OVER (PARTITION BY ex.repo_id, ex.path, ex.field ORDER BY pos) AS n FROM ex JOIN text ON text.repo_id = ex.repo_id AND text.path = ex.target || ext WHERE pos = 0 OR NOT contains(target, '.')),
es AS (""" + " UNION ALL ".join(
    f"SELECT repo_id, path, '{k}' AS kind, CAST({c} AS DOUBLE) AS confidence, {S.q(r)} AS reason, CAST(NULL AS INTEGER) AS line FROM text WHERE {S.hit('path', rx)}"
    for rx, k, c, r in ep.PATH_RULES
) + f""" UNION ALL {_CONTENT}
  UNION ALL SELECT repo_id, path, CASE field WHEN 'bin' THEN 'cli' ELSE 'library' END, CAST(CASE field WHEN 'bin' THEN 0.95 WHEN 'main' THEN 0.8 ELSE 0.7 END AS DOUBLE), '`' || field || '` in ' || manifest || ' points here', NULL FROM eh WHERE n = 1),
en AS (SELECT repo_id, path, arg_min(kind, o) AS kind, arg_min(confidence, o) AS confidence, string_agg(reason, '; ' ORDER BY o) AS reasons, string_agg(coalesce(CAST(line AS VARCHAR), '-'), ',' ORDER BY o) AS lines
  FROM (SELECT *, {{'c': -confidence, 'k': {_RANK}, 'r': reason, 'l': coalesce(line, -1)}} AS o FROM es) GROUP BY 1, 2),
ee AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, path) AS INTEGER) AS rank, count(*) OVER (PARTITION BY repo_id) AS total FROM en)"""


@query("entrypoints", f"WITH {ADMITTED}, {ENTRIES} SELECT * FROM ee")
def entrypoints(spark, d):
    # Read by the ranks and by the totals, and narrow next to the corpus: written once.
    signals = stored(ep.entrypoint_signals(scans.corpus(spark, d).where("admitted")), run_folder(spark), "signals")
    out = ep.entrypoints(signals)
    lines = F.transform("lines", lambda n: F.coalesce(n.cast("string"), F.lit("-")))
    return out.withColumn("reasons", F.array_join("reasons", "; ")).withColumn("lines", F.array_join(lines, ","))


# Importance of modules (mi) from fan-in, files and entrypoints.
IMPORTANCE = f"""{EDGES}, {ENTRIES},
fi AS (SELECT repo_id, depends_on AS name, count(*) AS fan_in FROM mx GROUP BY 1, 2),
mc AS (SELECT mo.repo_id, mo.path, count(*) AS file_count, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages
  FROM mo JOIN (SELECT *, {S.language()} AS language FROM text) t ON t.repo_id = mo.repo_id AND (mo.path = '.' OR starts_with(t.path, mo.path || '/')) GROUP BY 1, 2),
mt AS (SELECT DISTINCT mo.repo_id, mo.path FROM mo JOIN en ON en.repo_id = mo.repo_id AND (mo.path = '.' OR mo.path = en.path OR starts_with(en.path, mo.path || '/'))),
mi AS (SELECT mo.repo_id, mo.path, mo.name, mo.kind, coalesce(fan_in, 0) AS fan_in, coalesce(file_count, 0) AS file_count, coalesce(languages, '') AS languages,
  floor((0.5::DOUBLE * (coalesce(fan_in, 0) / (coalesce(fan_in, 0) + 3.0::DOUBLE)) + 0.3::DOUBLE * (coalesce(file_count, 0) / (coalesce(file_count, 0) + 20.0::DOUBLE))
   + 0.2::DOUBLE * CASE WHEN mt.path IS NULL THEN 0 ELSE 1 END) * 10000 + 0.5) / 10000 AS importance
  FROM mo LEFT JOIN fi ON fi.repo_id = mo.repo_id AND fi.name = mo.name LEFT JOIN mc ON mc.repo_id = mo.repo_id AND mc.path = mo.path LEFT JOIN mt ON mt.repo_id = mo.repo_id AND mt.path = mo.path)"""


@query(
    "module_importance",
    f"WITH {IMPORTANCE} SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY importance DESC, path) AS INTEGER) AS rank FROM mi",
)
def module_importance(spark, d):
    out = _map(spark, d)["modules"]
    return out.withColumn("languages", F.coalesce(F.array_join("languages", ","), F.lit("")))


_SCRIPT = r"""(?:\bfrom|\bimport|\brequire)\s*\(?\s*["']([^"']+)["']"""
_SCRIPT_RULES = {
    "TypeScript": r"^(?:export\s+)?(?:declare\s+)?",
    "JavaScript": r"^(?:export\s+)?",
}
# Imports, edges and declarations of the script files, the only sources among the files with contents.
SOURCES = f"""
sl AS (SELECT el.repo_id, el.path, i AS line, trim(t) AS t, {S.language('el.path')} AS language, {S.dirname('el.path')} AS dir FROM el),
si AS (SELECT repo_id, path, line, dir, language, unnest(regexp_extract_all(t, {S.q(_SCRIPT)}, 1)) AS s FROM sl WHERE language IN ('TypeScript', 'JavaScript') AND NOT starts_with(t, '//') AND NOT starts_with(t, '*') AND NOT starts_with(t, '/*')),
sb AS (SELECT *, CASE WHEN dir = '' THEN '' ELSE dir || '/' END || substr(s, 3) AS base FROM si WHERE starts_with(s, './')),
sc AS (SELECT *, unnest(list_concat([base], CASE WHEN base LIKE '%.js' THEN [left(base, length(base) - 3) || e FOR e IN ['.ts', '.tsx', '.js', '.jsx']] ELSE [] END, [base || e FOR e IN ext], [base || '/index' || e FOR e IN ext])) AS x,
  generate_subscripts(list_concat([base], CASE WHEN base LIKE '%.js' THEN [left(base, length(base) - 3) || e FOR e IN ['.ts', '.tsx', '.js', '.jsx']] ELSE [] END, [base || e FOR e IN ext], [base || '/index' || e FOR e IN ext]), 1) AS pos
  FROM (SELECT *, CASE language WHEN 'TypeScript' THEN ['.ts', '.tsx', '.d.ts', '.js', '.jsx', '.mjs', '.cjs'] ELSE ['.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx'] END AS ext FROM sb)),
sf AS (SELECT sc.repo_id, sc.path, sc.line, sc.s, arg_min(x, pos) AS dst FROM sc JOIN tree ON tree.repo_id = sc.repo_id AND tree.path = x GROUP BY 1, 2, 3, 4),
sn AS (SELECT repo_id, name, min(path) AS dir FROM mo GROUP BY 1, 2),
sr AS (SELECT si.repo_id, si.path, CASE WHEN sf.dst IS NOT NULL THEN sf.dst WHEN starts_with(si.s, '.') THEN NULL WHEN sn.dir IS NOT NULL AND sd.dir IS NOT NULL THEN 'module:' || sn.dir
   WHEN starts_with(si.s, '@') THEN 'external:' || split_part(si.s, '/', 1) || '/' || split_part(si.s, '/', 2) ELSE 'external:' || split_part(si.s, '/', 1) END AS dst,
   CASE WHEN sf.dst IS NOT NULL THEN 'file' WHEN sn.dir IS NOT NULL AND sd.dir IS NOT NULL THEN 'module' ELSE 'external' END AS kind
  FROM si LEFT JOIN sf ON sf.repo_id = si.repo_id AND sf.path = si.path AND sf.line = si.line AND sf.s = si.s
  LEFT JOIN sn ON sn.repo_id = si.repo_id AND sn.name = CASE WHEN starts_with(si.s, '@') THEN split_part(si.s, '/', 1) || '/' || split_part(si.s, '/', 2) ELSE split_part(si.s, '/', 1) END AND NOT starts_with(si.s, '.')
  LEFT JOIN (SELECT DISTINCT repo_id, array_to_string(p[1:i], '/') AS dir FROM (SELECT repo_id, p, unnest(range(1, len(p))) AS i FROM (SELECT repo_id, string_split(path, '/') AS p FROM tree))) sd ON sd.repo_id = sn.repo_id AND sd.dir = sn.dir),
se AS (SELECT repo_id, path AS src, dst, kind, count(*) AS weight FROM sr WHERE dst IS NOT NULL GROUP BY ALL),
sy AS (""" + " UNION ALL ".join(
    f"SELECT repo_id, CASE WHEN regexp_matches(t, {S.q(head + r'class\s+[A-Za-z_$]')}) THEN 'class' WHEN regexp_matches(t, {S.q(head + r'(?:async\s+)?function\s+[A-Za-z_$]')}) THEN 'function'"
    f" WHEN regexp_matches(t, {S.q(head + r'const\s+[A-Za-z_$]')}) THEN 'constant' END AS kind FROM sl WHERE language = '{language}' AND NOT starts_with(t, '//')"
    for language, head in _SCRIPT_RULES.items()
) + ")"


def _list(name: str, table: str, order: str, shown: str) -> str:
    limit = plan.CONTEXT_LIMITS[name]
    return f"""c_{name} AS (SELECT repo_id, string_agg(shown, ',' ORDER BY n) FILTER (n <= {limit}) AS {name}, count(*) AS {name}_total
  FROM (SELECT repo_id, {shown} AS shown, row_number() OVER (PARTITION BY repo_id ORDER BY {order}) AS n FROM {table}) GROUP BY 1)"""


@query(
    "repository_context",
    f"""WITH {IMPORTANCE}, {SOURCES},
us AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, file_count DESC, language) AS n FROM (SELECT repo_id, {S.language()} AS language, count(*) AS file_count, sum(size) AS bytes FROM text WHERE {S.language()} IS NOT NULL GROUP BY 1, 2)),
pl AS (SELECT repo_id, arg_min(language, CASE WHEN {S.programming('language')} THEN 0 ELSE 1000000 END + n) AS primary_language FROM us GROUP BY 1),
im AS (SELECT coalesce(ee.repo_id, c.repo_id) AS repo_id, coalesce(ee.path, c.path) AS path,
  greatest(coalesce(floor((0.55::DOUBLE + 0.35::DOUBLE * ee.confidence) * 10000 + 0.5) / 10000, 0), CASE WHEN c.path IS NULL THEN 0 WHEN contains(c.path, '/') THEN 0.6 ELSE 0.8 END) AS importance
  FROM ee FULL JOIN (SELECT repo_id, path FROM text WHERE {scans._PRED["is_config"]}) c ON c.repo_id = ee.repo_id AND c.path = ee.path),
xd AS (SELECT DISTINCT repo_id, manifest, kind, name FROM md),
sk AS (SELECT repo_id, kind, count(*) AS n FROM sy WHERE kind IS NOT NULL GROUP BY 1, 2),
{_list("modules", "mi", "importance DESC, path", "path")}, {_list("files", "im", "importance DESC, path", "path")},
{_list("edges", "se", "weight DESC, src, dst", "src || '>' || dst || ':' || weight")}, {_list("dependencies", "xd", "manifest, name, kind", "manifest || ':' || name")},
c_symbols AS (SELECT repo_id, string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) AS symbols, CAST(sum(n) AS BIGINT) AS symbols_total FROM sk GROUP BY 1)
SELECT pl.repo_id, primary_language, coalesce(modules, '') AS modules, coalesce(modules_total, 0) AS modules_total, coalesce(files, '') AS files, coalesce(files_total, 0) AS files_total,
 coalesce(edges, '') AS edges, coalesce(edges_total, 0) AS edges_total, coalesce(dependencies, '') AS dependencies, coalesce(dependencies_total, 0) AS dependencies_total,
 coalesce(symbols, '') AS symbols, coalesce(symbols_total, 0) AS symbols_total
FROM pl LEFT JOIN c_modules USING (repo_id) LEFT JOIN c_files USING (repo_id) LEFT JOIN c_edges USING (repo_id) LEFT JOIN c_dependencies USING (repo_id) LEFT JOIN c_symbols USING (repo_id)""",
)
def repository_context(spark, d):
    folder = run_folder(spark)
    corpus = scans.corpus_once(spark, d, folder)
    parts = plan.repo_map(corpus, folder=folder)
    links = plan.dependency_graph(corpus, parts["modules"], folder=folder, listing=parts["listing"])
    out = plan.repo_context(parts, links, plan.symbol_map(corpus), folder=folder)
    number = lambda x: x.cast("long").cast("string")
    shown = {
        "modules": lambda x: x["a"],
        "files": lambda x: x["a"],
        "edges": lambda x: F.concat(x["a"], F.lit(">"), x["b"], F.lit(":"), number(x["score"])),
        "dependencies": lambda x: F.concat(x["a"], F.lit(":"), x["b"]),
        "symbols": lambda x: F.concat(x["a"], F.lit(":"), number(x["score"])),
    }
    cells = [c for k, f in shown.items() for c in (
        F.coalesce(F.array_join(F.transform(k, f), ","), F.lit("")).alias(k), F.coalesce(f"{k}_total", F.lit(0)).cast("long").alias(f"{k}_total")
    )]
    return out.select("repo_id", "primary_language", *cells)
