"""Views that turn the driver tables into audit inputs.

Each view is one SELECT that both Spark SQL and DuckDB accept, so the two sides
of a check start from the same rows; everything after the view is written
separately.  ``{table}`` marks a driver table; other view names are CTEs.
No view filters, samples or cuts its table.
"""

from __future__ import annotations

import re

# Paths handed out to line items; a repository is ten consecutive orders.
TREE_PATHS = """
README.md LICENSE CONTRIBUTING.md SECURITY.md .env.example CODE_OF_CONDUCT.md CHANGELOG.md docs/API.md
docs/guide.md package.json package-lock.json yarn.lock requirements.txt pyproject.toml Cargo.toml go.mod
pnpm-workspace.yaml foundry.toml hardhat.config.ts .gitignore .env .env.local .github/workflows/ci.yml
.github/workflows/release.yaml Dockerfile docker-compose.yml src/index.ts src/main.py src/app.js
src/util/check.ts src/lib.rs src/main.rs cmd/main.go contracts/Token.sol contracts/addresses.json
scripts/deploy.ts test/Token.t.sol tests/app.test.ts tests/test_main.py fixtures/sample.ts examples/demo.js
assets/logo.png docs/audit.md node_modules/x/index.js dist/out.js vite.config.ts next.config.js vercel.json
fly.toml packages/a/package.json packages/a/src/index.ts packages/b/package.json packages/b/src/index.js
packages/b/lib/x.ts apps/web/index.html config/chain.json deploy/run.sh lib/tool.rb proto/api.proto
schema.graphql app/Main.java data/blob.bin Jenkinsfile pytest.ini artifacts/abi.json notes.txt
ARCHITECTURE.md tsconfig.json packages/a/lib/y.ts packages/a/lib/z.ts
""".split()
_NAMES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(TREE_PATHS))
NL = "chr(10)"


def _lines(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


_S = "cast(t.seed as string)"
_ADDRESS = f"'0x' || md5({_S}) || substr(md5({_S}), 1, 8)"

_README = f"""CASE WHEN t.seed % 7 = 0 THEN 'Hi ' || {_S} ELSE {_lines(
    "coalesce(d.text, 'no text')",
    "CASE t.seed % 4 WHEN 0 THEN '## Installation' WHEN 1 THEN '# Configuration' ELSE '## About' END",
    "CASE t.seed % 3 WHEN 0 THEN 'npm test' WHEN 1 THEN 'Demo: https://demo' || " + _S
    + " || '.vercel.app/x' ELSE 'see https://youtu.be/' || " + _S + " END",
    "CASE t.seed % 5 WHEN 0 THEN '# Architecture' WHEN 1 THEN 'Built with care, see twitter' "
    "WHEN 2 THEN 'deployed on polygon at ' || " + _ADDRESS + " WHEN 3 THEN '12 passing' ELSE 'plain' END",
)} END"""
_NAME = f"CASE t.path WHEN 'packages/a/package.json' THEN 'mod-a' WHEN 'packages/b/package.json' THEN 'mod-b' ELSE 'pkg-' || {_S} END"
_PACKAGE = f"""CASE t.seed % 7
 WHEN 0 THEN '{{"name": "' || {_NAME} || '"}}'
 WHEN 1 THEN '{{"name": "' || {_NAME} || '", "scripts": {{}}, "packageManager": "pnpm@9.1.0"}}'
 WHEN 2 THEN '{{"name": "' || {_NAME} || '", "scripts": {{"test": "vitest", "dev": "vite"}}, "dependencies": {{"react": "18", "next": "14", "mod-b": "1", "pkg-' || cast(t.seed % 50 as string) || '": "*"}}, "devDependencies": {{"vitest": "1"}}, "main": "src/index"}}'
 WHEN 3 THEN '{{"name": "root", "workspaces": ["packages/*"], "scripts": {{"start": "node src/app.js"}}, "dependencies": {{"pg": "8", "ioredis": "5", "@scope/tool": "2", "mod-a": "workspace:*", "mod-b": "workspace:*"}}, "bin": {{"tool": "./src/app.js"}}}}'
 WHEN 4 THEN '{{"name": '
 WHEN 5 THEN '{{"name": "' || {_NAME} || '", "scripts": {{"build": "tsc", "test:unit": "jest"}}, "peerDependencies": {{"vue": "3", "mod-a": "^1"}}, "optionalDependencies": {{"svelte": "4"}}, "exports": {{".": "./src/util/check.ts"}}}}'
 ELSE '{{"scripts": {{"dev": ""}}, "devDependencies": {{"hardhat": "2", "jest": "29", "mod-a": "*"}}, "bin": "src/index.ts"}}' END"""
_CODE = _lines(
    "'import { a } from \"./util/check.js\";'",
    "'import React from ''react'';'",
    "CASE t.seed % 3 WHEN 0 THEN 'export function isReady() {' || chr(10) || '  return true;' || chr(10) || '}' "
    "WHEN 1 THEN 'const verifyAll = (x) => { return null }' ELSE 'function total(a, b) {' || chr(10) || '  return a + b;' || chr(10) || '}' END",
    "CASE t.seed % 4 WHEN 0 THEN 'try { go() } catch (e) { }' WHEN 1 THEN 'import nock from \"x\"; import { n } from ''nock''' "
    "ELSE 'export class Box' || cast(t.seed % 9 as string) || ' {' || chr(10) || '  size = 1' || chr(10) || '}' END",
    "CASE t.seed % 5 WHEN 0 THEN '// TODO finish ' || " + _S + " WHEN 1 THEN '/* FIXME later */' ELSE 'export const LIMIT = 5;' END",
    "'const key = \"' || md5(" + _S + ") || '\";'",
)

VIEWS: dict[str, str] = {
    # Listing: distinct paths per repository with a size and a listing position.
    "tree": f"""
SELECT 'r' || cast(cast(floor(l.l_orderkey / 10) as bigint) as string) AS repo_id, n.path AS path,
       cast(max(floor(l.l_extendedprice * 12)) as bigint) AS size,
       min(l.l_partkey * 1000 + n.k) AS list_pos, min(l.l_partkey) AS seed
FROM {{lineitem}} AS l JOIN (VALUES {_NAMES}) AS n(k, path)
  ON n.k = (l.l_partkey * 7 + l.l_suppkey * 3 + l.l_linenumber) % {len(TREE_PATHS)}
GROUP BY 1, 2""",
    # Contents; prose comes from documents by id, the other files are written from the row.
    "files": f"""
SELECT t.repo_id AS repo_id, t.path AS path,
 CASE WHEN t.path = 'README.md' THEN {_README}
  WHEN t.path IN ('docs/guide.md', 'docs/API.md', 'notes.txt', 'ARCHITECTURE.md') THEN d.text
  WHEN t.path LIKE '%package.json' THEN {_PACKAGE}
  WHEN t.path = '.gitignore' THEN CASE WHEN t.seed % 2 = 0 THEN {_lines("'node_modules'", "'.env'")} ELSE 'dist' END
  WHEN t.path LIKE '.github/%' THEN CASE t.seed % 4 WHEN 0 THEN {_lines("'on: push'", "'jobs:'", "'  a: b'")}
    WHEN 1 THEN 'name: x' WHEN 2 THEN '' ELSE 'on: push' END
  WHEN t.path = 'pyproject.toml' THEN CASE t.seed % 3 WHEN 0 THEN {_lines(
      "'[project]'", "'name = \"py' || " + _S + " || '\"'", "'dependencies = ['", "'  \"requests>=2\",'",
      "'  \"pytest\"'", "']'")}
    WHEN 1 THEN {_lines("'[tool.poetry]'", "'[tool.poetry.dependencies]'", "'python = \"^3\"'", "'numpy = \"1.26\"'")}
    ELSE '[build-system]' END
  WHEN t.path = 'requirements.txt' THEN {_lines("'# pinned'", "'flask==' || cast(t.seed % 4 as string) || '.0'", "'-r base.txt'", "'uvicorn[standard] >= 0.2 ; python_version > \"3\"'")}
  WHEN t.path = 'Cargo.toml' THEN {_lines("'[package]'", "'name = \"crate' || " + _S + " || '\"'", "'[dependencies]'", "'serde = { version = \"1\", features = [\"derive\"] }'", "'[dev-dependencies]'", "'rand = \"0.8\"'")}
  WHEN t.path = 'go.mod' THEN {_lines("'module example.com/app' || " + _S, "'require ('", "'  golang.org/x/net v0.1.0'", "')'", "'require github.com/a/b v1.2.3'")}
  WHEN t.path = 'pnpm-workspace.yaml' THEN {_lines("'packages:'", "'  - \"packages/*\"'", "'  - apps/**'")}
  WHEN t.path = 'Dockerfile' THEN {_lines("'FROM node:20'", "'CMD [\"node\"]'")}
  WHEN t.path = 'config/chain.json' THEN CASE t.seed % 4 WHEN 0 THEN '{{"chainId": 137}}' WHEN 1 THEN 'network: sepolia'
    WHEN 2 THEN '{{"address": "' || {_ADDRESS} || '"}}' ELSE '{{}}' END
  WHEN t.path = 'contracts/addresses.json' THEN '{{"token": "' || {_ADDRESS} || '"}}'
  WHEN t.path LIKE '%.ts' OR t.path LIKE '%.js' THEN {_CODE}
 END AS content
FROM tree AS t LEFT JOIN {{documents}} AS d ON d.doc_id = t.seed""",
    # Prose corpus: a repository per source.
    "doc_files": """
SELECT source AS repo_id, 'docs/' || lang || '/d' || cast(doc_id as string) ||
       CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.ts' END AS path,
       doc_id AS list_pos, n_chars AS size, text AS content
FROM {documents}""",
    # Chat transcripts as markdown lines.
    "conv_lines": """
SELECT 'conv' AS repo_id, 'conversations/' || cast(conv_id as string) || '.md' AS path,
       cast(turn + 1 as int) AS line, role || ': ' || text AS text
FROM {conversations}""",
    # One patch per document: added, context and removed lines.
    "commit_files": """
SELECT source AS repo_id, md5(cast(doc_id as string)) AS sha, 'change ' || cast(doc_id as string) AS subject,
       lang || '/d' || cast(doc_id % 40 as string) || '.ts' AS filename, doc_id AS seq,
       '@@ -1,2 +' || cast(doc_id % 9 + 1 as string) || ',3 @@ head' || chr(10) || '--- a' || chr(10) || '+++ b' || chr(10) ||
       ' ctx' || chr(10) || '+' || replace(replace(text, chr(10), chr(10) || '+'), '. ', '.' || chr(10) || '-') ||
       chr(10) || '@@ -9 +' || cast(doc_id % 5 + 90 as string) || ' @@' || chr(10) || '+tail' || chr(10) || ' end' AS patch
FROM {documents}""",
    # Source files: one per order, one line per line item, eight languages.
    "code_lines": """
SELECT 'c' || cast(cast(floor(l_orderkey / 40) as bigint) as string) AS repo_id,
       CASE l_orderkey % 8 WHEN 0 THEN 'src/m' || cast(l_orderkey % 40 as string) || '.ts'
         WHEN 1 THEN 'src/m' || cast(l_orderkey % 40 as string) || '.js'
         WHEN 2 THEN 'pkg/m' || cast(l_orderkey % 40 as string) || '.py'
         WHEN 3 THEN 'cmd/m' || cast(l_orderkey % 40 as string) || '.go'
         WHEN 4 THEN 'src/m' || cast(l_orderkey % 40 as string) || '.rs'
         WHEN 5 THEN 'src/main/java/M' || cast(l_orderkey % 40 as string) || '.java'
         WHEN 6 THEN 'contracts/M' || cast(l_orderkey % 40 as string) || '.sol'
         ELSE 'lib/m' || cast(l_orderkey % 40 as string) || '.rb' END AS path,
       cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord,
       CASE l_orderkey % 8
         WHEN 0 THEN CASE l_suppkey % 7 WHEN 0 THEN 'import { a } from "./m' || cast(l_partkey % 5 * 8 as string) || '.js";'
           WHEN 1 THEN 'export class C' || cast(l_partkey as string) || ' {'
           WHEN 2 THEN 'export function f' || cast(l_partkey as string) || '() { return 1; }'
           WHEN 3 THEN '}' WHEN 4 THEN 'const k' || cast(l_partkey as string) || ' = require("pkg' || cast(l_partkey % 9 as string) || '/x");'
           WHEN 5 THEN '// import { b } from "./no";' ELSE '  let v' || cast(l_partkey as string) || ' = "{";' END
         WHEN 1 THEN CASE l_suppkey % 5 WHEN 0 THEN 'import x from "./m' || cast(l_partkey % 5 * 8 + 1 as string) || '";'
           WHEN 1 THEN 'function g' || cast(l_partkey as string) || '() {' WHEN 2 THEN '}'
           WHEN 3 THEN 'export * from "@s/p' || cast(l_partkey % 4 as string) || '/deep";' ELSE 'var w' || cast(l_partkey as string) || ' = 1' END
         WHEN 2 THEN CASE l_suppkey % 7 WHEN 0 THEN 'from .m' || cast(l_partkey % 5 * 8 + 2 as string) || ' import a, b as c'
           WHEN 1 THEN 'import os, pkg.m' || cast(l_partkey % 5 * 8 + 2 as string) WHEN 2 THEN 'class K' || cast(l_partkey as string) || ':'
           WHEN 3 THEN '    def m' || cast(l_partkey as string) || '(self):' WHEN 4 THEN '        return 1'
           WHEN 5 THEN 'LIMIT' || cast(l_partkey as string) || ' = 3' ELSE '    @cached' END
         WHEN 3 THEN CASE l_suppkey % 5 WHEN 0 THEN 'import "example.com/x/cmd"' WHEN 1 THEN 'func F' || cast(l_partkey as string) || '() {'
           WHEN 2 THEN '}' WHEN 3 THEN 'type t' || cast(l_partkey as string) || ' struct {' ELSE 'var z' || cast(l_partkey as string) || ' = 1' END
         WHEN 4 THEN CASE l_suppkey % 5 WHEN 0 THEN 'use crate::m' || cast(l_partkey % 5 * 8 + 4 as string) || ';' WHEN 1 THEN 'mod m' || cast(l_partkey % 5 * 8 + 4 as string) || ';'
           WHEN 2 THEN 'pub struct S' || cast(l_partkey as string) || ' {' WHEN 3 THEN '}' ELSE 'pub fn h' || cast(l_partkey as string) || '() {}' END
         WHEN 5 THEN CASE l_suppkey % 4 WHEN 0 THEN 'import java.util.List' || cast(l_partkey % 6 as string) || ';' WHEN 1 THEN 'public class J' || cast(l_partkey as string) || ' {'
           WHEN 2 THEN '}' ELSE '  public void run' || cast(l_partkey as string) || '() { }' END
         WHEN 6 THEN CASE l_suppkey % 5 WHEN 0 THEN 'import "./M' || cast(l_partkey % 5 * 8 + 6 as string) || '.sol";' WHEN 1 THEN 'contract T' || cast(l_partkey as string) || ' {'
           WHEN 2 THEN '}' WHEN 3 THEN '  function q' || cast(l_partkey as string) || '() public {}' ELSE '  uint256 public total' || cast(l_partkey as string) || ';' END
         ELSE CASE l_suppkey % 5 WHEN 0 THEN 'require_relative "m' || cast(l_partkey % 5 * 8 + 7 as string) || '"' WHEN 1 THEN 'class R' || cast(l_partkey as string)
           WHEN 2 THEN '  def x' || cast(l_partkey as string) WHEN 3 THEN '  end' ELSE 'end' END
       END AS text
FROM {lineitem}""",
    "code_files": """
SELECT repo_id, path, [[lines text ord]] AS content,
       cast(sum(length(text) + 1) as bigint) AS size, cast(min(ord) as bigint) AS list_pos
FROM code_lines GROUP BY repo_id, path""",
    # Findings of two audits: rows with side 0 and 2 are in the base, 1 and 2 in the head.
    "findings": """
SELECT 'r' || cast(cast(floor(l_orderkey / 10) as bigint) as string) AS repo_id,
       (l_partkey + l_linenumber) % 3 AS side,
       'src/f' || cast(l_partkey % 12 as string) || CASE l_partkey % 4 WHEN 0 THEN '.test.ts' WHEN 1 THEN '.md' ELSE '.ts' END AS file,
       cast(l_linenumber * 10 + floor(l_quantity) as int) AS line,
       CASE l_suppkey % 12 WHEN 0 THEN 'doc-license' WHEN 1 THEN 'doc-readme' WHEN 2 THEN 'repro-no-ci'
         WHEN 3 THEN 'repro-no-lockfile' WHEN 4 THEN 'web3-no-contract-tests' WHEN 5 THEN 'hack-no-license'
         WHEN 6 THEN 'injection-f' WHEN 7 THEN 'secret-history-aws-' || cast(l_partkey as string)
         WHEN 8 THEN 'ai-empty-catch-' || cast(l_partkey as string) WHEN 9 THEN 'custom thing!' || cast(l_suppkey % 5 as string)
         WHEN 10 THEN 'doc-readme-section-run' ELSE 'secret-db-' || cast(l_partkey as string) END AS id,
       CASE l_suppkey % 12 WHEN 0 THEN 'doc' WHEN 1 THEN 'doc' WHEN 2 THEN 'repro' WHEN 3 THEN 'repro' WHEN 4 THEN 'web3'
         WHEN 5 THEN 'hack' WHEN 8 THEN 'quality' WHEN 9 THEN 'hygiene' WHEN 10 THEN 'doc' ELSE 'security' END AS section,
       CASE WHEN l_returnflag = 'A' AND l_linenumber > 4 THEN 'critical' WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN 'high'
         WHEN l_returnflag = 'N' AND l_linenumber > 3 THEN 'medium' ELSE 'low' END AS severity,
       l_orderkey * 1000 + l_linenumber * 100 + l_suppkey AS ord, l_partkey AS part, l_suppkey AS supp
FROM {lineitem}""",
    # Job events: a job is one user's traffic.
    "job_events": """
SELECT 'j' || cast(user_id as string) AS job_id, 'r' || cast(user_id % 50 as string) AS repo_id, ts,
       CASE event_type WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed'
         WHEN 'error' THEN 'failed' ELSE 'queued' END AS event,
       value <= 60 AS retryable, event_id
FROM {events}""",
    "audit_jobs": """
SELECT 'j' || cast(event_id as string) AS job_id, 'r' || cast(user_id as string) AS repo_id, ts AS created_at,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'completed' END AS status,
       CASE WHEN value > 100 THEN 100.0 WHEN value < 0 THEN 0.0 ELSE value END AS overall,
       CASE event_type WHEN 'error' THEN CASE event_id % 6 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Repo Not Found'
         WHEN 2 THEN 'Validation failed' WHEN 3 THEN 'Host Not Allowed' WHEN 4 THEN 'rate LIMIT' ELSE 'boom' END END AS error,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'key' || cast(user_id as string) || props END AS idempotency_key
FROM {events}""",
    # Lines shaped like credentials, samples and look-alikes; assembled from row values, none is real.
    "secret_lines": """
SELECT 's' || cast(cast(floor(l_orderkey / 50) as bigint) as string) AS repo_id,
       CASE l_partkey % 5 WHEN 0 THEN 'src/c' || cast(l_orderkey as string) || '.ts' WHEN 1 THEN 'docs/c' || cast(l_orderkey as string) || '.md'
         WHEN 2 THEN '.env.example' WHEN 3 THEN 'tests/c' || cast(l_orderkey as string) || '.py' ELSE 'conf/c' || cast(l_orderkey as string) || '.yml' END AS path,
       cast(l_linenumber * 100 + l_suppkey % 100 as int) AS line,
       CASE l_suppkey % 13
         WHEN 0 THEN 'id = "AK' || 'IA' || upper(substr(md5(cast(l_partkey as string)), 1, 16)) || '"'
         WHEN 1 THEN 'url: post' || 'gres://app:' || md5(cast(l_partkey as string)) || '@db' || cast(l_partkey % 4 as string) || '.internal/app'
         WHEN 2 THEN 'url: mys' || 'ql://root:' || cast(l_partkey as string) || '@localhost:3306/x'
         WHEN 3 THEN 'pass' || 'word = "' || md5(cast(l_orderkey as string)) || '"'
         WHEN 4 THEN 'pass' || 'word = "changeme' || cast(l_partkey as string) || '"'
         WHEN 5 THEN '-----BEGIN ' || 'RSA PRIVATE KEY-----'
         WHEN 6 THEN 'token = "' || md5(cast(l_partkey as string)) || upper(md5(cast(l_suppkey as string))) || '"'
         WHEN 7 THEN 'see https://host.example.com/' || md5(cast(l_partkey as string)) || upper(md5(cast(l_suppkey as string)))
         WHEN 8 THEN 'sha512-' || md5(cast(l_partkey as string)) || upper(md5(cast(l_suppkey as string)))
         WHEN 9 THEN 'API_KEY=' || md5(cast(l_partkey as string)) || upper(md5(cast(l_orderkey as string)))
         WHEN 10 THEN 'bot = 12' || cast(10000000 + l_partkey as string) || ':' || substr(md5(cast(l_partkey as string)) || 'abcdef', 1, 35)
         WHEN 11 THEN 'path src/app-module-' || md5(cast(l_partkey as string)) || '/index.ts'
         ELSE 'nothing to see in line ' || cast(l_partkey as string) END AS text
FROM {lineitem}""",
    # Part names strung together per order: the longer ones are word runs of 12 and more.
    "name_lines": """
SELECT 'n' || cast(cast(floor(l_orderkey / 100) as bigint) as string) AS repo_id, 'notes/o' || cast(l_orderkey as string) || '.txt' AS path,
       1 AS line, CASE WHEN l_orderkey % 4 = 0 THEN 'note 1 ' ELSE '' END || [[words p_name ord]] AS text
FROM (SELECT l_orderkey, p_name, l_linenumber * 1000000 + l_partkey AS ord FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) AS x
GROUP BY l_orderkey""",
    "wordlist": """
SELECT DISTINCT word FROM (SELECT split_part(p_name, ' ', 1) AS word FROM {part} UNION ALL SELECT split_part(p_name, ' ', 2) FROM {part}) AS w
WHERE word <> ''""",
    # Requests with the eight key fields.
    "requests": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE md5(cast(user_id as string)) END AS commitSha,
       event_id % 2 = 0 AS includeLaunchCopy, CASE event_id % 2 WHEN 0 THEN 'quick' ELSE 'full' END AS mode,
       'en' AS outputLanguage, 'o' || cast(user_id as string) AS owner, 'repo' AS repo, '1.3' AS reportVersion,
       'open_source' AS target, ts
FROM {events}""",
}


def _needed(text: str) -> list[str]:
    """View names used by ``text``, dependencies first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"(?i)\b(?:FROM|JOIN)\s+{name}\b", text):
            for sub in _needed(VIEWS[name]):
                if sub not in out:
                    out.append(sub)
            if name not in out:
                out.append(name)
    return out


def _with(text: str, resolve) -> str:
    names = _needed(text)
    own = re.match(r"(?i)\s*WITH\s+(RECURSIVE\s)?", text)
    ctes = ", ".join(f"{n} AS ({resolve(VIEWS[n])})" for n in names)
    if not ctes:
        return text
    if own:
        return f"WITH {own.group(1) or ''}{ctes}, " + text[own.end() :]
    return f"WITH {ctes} {text}"


_TABLE = re.compile(r"\{(lineitem|documents|conversations|events|pages|part)\}")
# Ordered string aggregation is the one construct the two dialects spell differently.
_JOIN = re.compile(r"\[\[(lines|words) (\w+) (\w+)\]\]")
_SEPARATOR = {"lines": "chr(10)", "words": "' '"}


def _fill(sql: str, table, aggregate: str) -> str:
    joined = _JOIN.sub(
        lambda m: aggregate.format(value=m.group(2), sep=_SEPARATOR[m.group(1)], order=m.group(3)), sql
    )
    return _TABLE.sub(lambda m: table(m.group(1)), joined)


def spark_sql(name: str, table, given: set[str] = frozenset()) -> str:
    """The view as one Spark statement; ``table`` maps a driver table, or a view among ``given``, to its name in the session."""
    within = "string_agg({value}, {sep}) WITHIN GROUP (ORDER BY {order})"
    stands = {VIEWS[v]: f"SELECT * FROM {table(v)}" for v in given if v in VIEWS}
    return _with(f"SELECT * FROM {name}", lambda s: stands.get(s) or _fill(s, table, within))


def oracle(sql: str) -> str:
    return _with(sql, lambda s: _fill(s, lambda t: t, "string_agg({value}, {sep} ORDER BY {order})"))
