"""Cheap conditions before a pattern lose none of its matches."""

import re

import pytest
from pyspark.sql import functions as F

from gatewright.functions import text as X
from gatewright.functions.patterns import RULES as D
from gatewright.operators import presence
from gatewright.operators.intel import entrypoints as ep
from gatewright.operators.intel import imports
from gatewright.queries import registry

TEXTS = [
    "on Ethereum MAINNET", "eth-mainnet", 'chainId": 1', "CHAINID=11155111", "Sepolia", "BSC", "bnb", "chainid 56", "bsctestnet", "BSC-Testnet",
    "chainId: 97", "Polygon", "chainid:137", "AMOY", "chainid 80002", "Arbitrum", "chainid 42161", "Optimism", "chainid=10", "on Base now",
    "chainid 8453", "basesepolia", "Base-Sepolia", "base sepolia", "chainid 84532", "XLayer", "x layer", "X-Layer", "chainid 196", "Solana",
    'cluster": devnet', "cluster mainnet", "chainid 101", "# Architecture", "## How It Works", "### the System design", "# our TECH stack",
    "Built With care", "made with x", "a Submission", "Track", "Project Description", "Twitter", "see X.com/a", "Farcaster", "warpcast", "Lenster",
    "Passing", "✅", "test pass", "tests PASS", "12 passing", "HACKATHON", "hack for a project", "Track: x", "submission: y", "nothing", "",
]
GUARDED = [
    *((D.CHAIN_KEYWORDS[n], D.CHAIN_LITERALS[n]) for n in D.CHAIN_KEYWORDS), *((D.NETWORK_KEYWORDS[n], D.NETWORK_LITERALS[n]) for n in D.NETWORK_KEYWORDS),
    (D.ARCHITECTURE_HEADING, D.ARCHITECTURE_LITERALS), (D.SUBMISSION_TEXT, D.SUBMISSION_LITERALS), (D.SOCIAL_TEXT, D.SOCIAL_LITERALS),
    (D.TEST_RESULT_TEXT, D.TEST_RESULT_LITERALS), (D.HACKATHON_TEXT, D.HACKATHON_LITERALS),
]


def test_a_guarded_pattern_says_what_the_pattern_says(spark):
    rows = spark.createDataFrame([(t,) for text in TEXTS for t in (text, f"words é {text} words")], "text string")
    text = F.col("text")
    pairs = [F.struct(X.says(text, F.lower(text), p, held).alias("said"), text.rlike(p).alias("matches")) for p, held in GUARDED]
    found = rows.select(F.array(*pairs).alias("pairs")).collect()
    assert all(said == matches for r in found for said, matches in r.pairs)
    assert all(any(r.pairs[i].matches for r in found) for i in range(len(GUARDED)))


def test_marks_hold_every_text(spark):
    files = spark.createDataFrame([(str(n), "docs/config.md", t) for n, t in enumerate(TEXTS)], "repo_id string, path string, content string")
    marked = {TEXTS[int(r.repo_id)]: r.marks for r in presence.file_marks(files).collect()}
    for i, name in enumerate(presence.MARKS):
        kind, _, key = name[1:].partition("_")
        rules = {"chain": D.CHAIN_KEYWORDS, "net": D.NETWORK_KEYWORDS}.get(kind)
        if name.startswith("_") and rules:
            want = {t for t in TEXTS if re.search(rules[key], t, re.A)}
            assert want and {t for t, marks in marked.items() if marks >> i & 1} == want


PATHS = [
    "a/src/index.tsx", "src/main.ts", "src/server.js", "src/app.jsx", "src/cli.mjs", "src/worker.ts", "src/bin/x.cjs", "index.mjs", "a/main.js", "app.tsx",
    "server.ts", "web/pages/_app.tsx", "app/layout.ts", "index.html", "a/__main__.py", "main.py", "wsgi.py", "asgi.py", "a/app.py", "manage.py",
    "src/main.rs", "src/bin/x.rs", "a/Program.cs", "vitest.config.ts", "cypress.config.js", "pytest.ini", "a/conftest.py", "phpunit.xml.dist",
    "script/a.s.sol", "contracts/A.sol", "src/A.sol",
]


def test_path_rules_meet_every_path(spark):
    tree = spark.createDataFrame([("r", p) for p in PATHS], "repo_id string, path string")
    found = sorted((r.path, r.reason) for r in ep.path_signals(tree).collect())
    want = [(p, reason) for p in PATHS for rx, _, _, reason in ep.PATH_RULES if re.search(rx.replace(r"\z", r"\Z"), p)]
    assert found == sorted(want) and {reason for _, reason in want} == {r[3] for r in ep.PATH_RULES}
    assert all(lit in p for p in PATHS for (rx, *_), lit in zip(ep.PATH_RULES, ep.PATH_LITERALS) if re.search(rx.replace(r"\z", r"\Z"), p))


@pytest.mark.parametrize(("own", "kept"), [("65535", "8000"), ("20000", "20000")])
def test_views_keep_generated_methods_short(spark, tmp_path, own, kept):
    spark.range(1).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "'x' AS text", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", own)
    try:
        assert registry.view(spark, str(tmp_path), "doc_files").count() == 1
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == kept
    finally:
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


LINES = {
    "a.sol": ['import "./A.sol";', 'import {B} from "./B.sol";', "contract C {"], "a.go": ['import "fmt"', 'import x "a/b"', "func F() {"],
    "a.rs": ["use crate::m1;", "pub use a::b;", "pub mod c;", "extern crate d;", "fn e() {}"], "A.java": ["import a.B;", "import static a.C;", "class D {"],
    "a.kt": ["import a.b", "fun c()"], "a.rb": ["require_relative 'm'", "require 'json'", "load 'x.rb'", "end"], "a.sh": [". ./env.sh", "source lib.sh", "ls"],
    "a.proto": ['import "a.proto";', 'import public "b.proto";', "message C {"], "a.graphql": ['#import "./a.graphql"', "type B {"],
    "a.ts": ['import { a } from "./a";', 'export * from "b";', 'const c = require("c");', '// import "no"', "}"], "a.js": ['import "d"', "var e = 1"],
    "a.py": ["import os, sys as s", "from .a import b", "x = 1"],
}


def test_lines_of_every_language_are_found(spark):
    files = spark.createDataFrame([("r", path, "\n".join(lines)) for path, lines in LINES.items()], "repo_id string, path string, content string")
    found = {(r.path, r.line) for r in imports.extract_imports(files).collect()}
    no = {"contract", "func", "fn", "class", "fun", "end", "ls", "message", "type", "//", "}", "var", "x"}
    assert found == {(p, n) for p, lines in LINES.items() for n, text in enumerate(lines, 1) if text.split()[0] not in no}
    rules = [(language, pattern) for language, held in imports.LINE_RULES.items() for pattern, _ in held]
    texts = [text for lines in LINES.values() for text in lines]
    for language, pattern in rules:
        met = [t for t in texts if re.search(pattern, t, re.A)]
        assert met and all(any(word in t for word in imports.LINE_WORDS[language]) for t in met)
