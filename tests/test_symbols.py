import random
import re

from helpers import corpus, rows

from gatewright.operators.intel import symbols
from gatewright.queries.registry import view

PY = '''import os

@decorated
@twice
class Box(Base):
    LIMIT = 3
    def _open(self):
        inner = 1
        return inner

    def close(self):
        pass

def top(a):
    return a
X = 1
'''
SOL = '''contract Counter {
    uint256 public total;
    function add() external {
        total += 1;
    }
}
'''
TS = '''export class Outer {
  size = 1
}
// class Hidden {
function free()
{
}
const LIMIT = "{";
'''
RB = '''class Tool
  def run
    1
  end
end
'''


def test_symbols_per_language(spark):
    _, files = corpus(spark, {"r": {"a.py": PY, "b.sol": SOL, "c.ts": TS, "d.rb": RB}})
    got = rows(symbols.extract_symbols(files), "path", "start_line", "end_line", "name", "kind", "parent", "exported")
    assert got == sorted(
        [
            ("a.py", 3, 12, "Box", "class", None, True),
            ("a.py", 6, 6, "LIMIT", "constant", "Box", True),
            ("a.py", 7, 9, "_open", "method", "Box", False),
            ("a.py", 11, 12, "close", "method", "Box", True),
            ("a.py", 14, 15, "top", "function", None, True),
            ("a.py", 16, 16, "X", "constant", None, True),
            ("b.sol", 1, 6, "Counter", "contract", None, True),
            ("b.sol", 2, 2, "total", "variable", "Counter", True),
            ("b.sol", 3, 5, "add", "function", "Counter", True),
            ("c.ts", 1, 3, "Outer", "class", None, True),
            ("c.ts", 5, 7, "free", "function", None, False),
            ("c.ts", 8, 8, "LIMIT", "constant", None, False),
            ("d.rb", 1, 5, "Tool", "class", None, True),
            ("d.rb", 2, 4, "run", "function", "Tool", True),
        ]
    )


def _strip(text):
    """Text outside quotes and line comments, character by character."""
    out, quote, at = "", None, 0
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = None
        elif c in "\"'":
            quote = c
        elif text[at : at + 2] == "//":
            break
        else:
            out += c
        at += 1
    return out


def _plain_symbols(content, language):
    """The declarations of one file by rescanning its lines for every question."""
    style, _, prefixes, rules = symbols.PROFILES[language]
    lines = re.split(r"\r?\n", content)
    texts = [line.strip(" \t\n\x0b\x0c\r\xa0  ﻿") for line in lines]
    indents = [len(re.match(r"[ \t]*", line).group().replace("\t", "    ")) for line in lines]
    skip = [not t or t.startswith(tuple(prefixes)) for t in texts]
    net = [_strip(line).count("{") - _strip(line).count("}") for line in lines]
    before = [sum(net[:i]) for i in range(len(lines) + 1)]

    def end(i):
        if style == "brace":
            for j in range(i, len(lines)):
                if any("{" in _strip(x) for x in lines[i : j + 1]) and before[j + 1] <= before[i]:
                    return j
            return i
        last = i
        for j in range(i + 1, len(lines)):
            if not skip[j]:
                if indents[j] <= indents[i]:
                    closing = {"Ruby": r"end(?!\w)", "Shell": r"\}"}.get(language)
                    return j if closing and indents[j] == indents[i] and re.match(closing, texts[j]) else last
                last = j
        return last

    def start(i):
        first = i
        for j in range(i - 1, -1, -1):
            if not skip[j]:
                if indents[j] != indents[i] or not texts[j].startswith("@"):
                    break
                first = j
        return first

    found, scopes = [], []  # scopes: (level, name, kind)
    for i, t in enumerate(texts):
        if skip[i] and language != "Solidity":
            continue
        level = before[i] if style == "brace" else indents[i]
        while scopes and (level < scopes[-1][0] if style == "brace" else level <= scopes[-1][0] + (language in ("Ruby", "Shell"))):
            scopes.pop()
        if skip[i]:
            continue
        for pattern, kind, scope in rules:
            m = re.match(pattern, t, re.ASCII)
            if not m:
                continue
            parents = [s for s in scopes if not (language == "Python" and s[2] == "function")]
            parent = parents[-1][1] if parents else None
            python = language == "Python"
            if kind == "assignment" and any(s[2] == "function" for s in scopes):
                break
            if kind == "state" and (not scopes or scopes[-1][0] != level):
                break
            one = kind in ("assignment", "state")
            first, last = (i, i) if one else (start(i) if python else i, end(i))
            if one:
                constant = re.fullmatch("[A-Z][A-Z0-9_]*", m[1]) if python else re.search(r"\bconstant\b", t, re.ASCII)
                kind = "constant" if constant else "variable"
            shown = "method" if python and kind == "function" and parent is not None else kind
            found.append((first + 1, last + 1, m[1], shown, parent))
            if scope:
                scopes.append((level + (style == "brace"), m[1], kind))
            break
    return sorted(found, key=str)


SUFFIX = {
    "TypeScript": "ts", "JavaScript": "js", "Go": "go", "Rust": "rs", "Java": "java", "Kotlin": "kt", "Swift": "swift", "Ruby": "rb",
    "Shell": "sh", "Protobuf": "proto", "GraphQL": "graphql", "Python": "py", "Solidity": "sol",
}
PARTS = {
    "brace": ["{", "}", "}}", "{ {", "x = '{'", "// {", "", "  ", "} else {", "{}", "call();", "/* { */", "* }", '"\\"{"', "#}"],
    "indent": ["x()", "end", "}", "", "# note", "@wraps", "@one", "pass", "end.x", "ending", "{"],
}
DECLARED = {
    "TypeScript": ["export class {n} {{", "interface {n}", "const {n} = {{", "let {n} = 1", "export function {n}() {{}}", "enum {n} {{ A }}"],
    "JavaScript": ["class {n} {{", "function {n}() {{", "var {n} = 1", "export const {n} = {{}}"],
    "Go": ["type {n} struct {{", "func (x T) {n}() {{", "const {n} = 1", "type {n} interface {{"],
    "Rust": ["pub struct {n} {{", "trait {n} {{", "pub async fn {n}() {{", "const {n}: u8 = 1;", "enum {n} {{"],
    "Java": ["public class {n} {{", "interface {n} {{", "public static void {n}() {{", "enum {n} {{ A }}"],
    "Kotlin": ["data class {n} {{", "fun {n}() {{", "interface {n}", "object {n} {{"],
    "Swift": ["struct {n} {{", "public func {n}() {{", "protocol {n} {{", "final class {n} {{"],
    "Ruby": ["def {n}", "class {n}", "module {n}", "LIMIT = 1"],
    "Shell": ["{n}() {{", "function {n}() {{", "LIMIT=1"],
    "Protobuf": ["message {n} {{", "enum {n} {{", "service {n} {{", "rpc {n} (A) returns (B);"],
    "GraphQL": ["type {n} {{", "interface {n} {{", "input {n} {{"],
    "Python": ["class {n}:", "def {n}():", "async def {n}(a):", "{n} = 1", "LIMIT: int = 2", "{n} == 2"],
    "Solidity": ["contract {n} {{", "library {n} {{", "function {n}() public {{", "uint256 public {n};", "uint constant {n} = 1;", "event {n}(uint a);", "constructor() {{", "struct {n} {{"],
}


def test_symbols_match_rescanning(spark):
    rng = random.Random(11)
    made = {}
    for language, suffix in SUFFIX.items():
        for n in range(40):
            lines = []
            for _ in range(rng.randint(0, 40)):
                part = rng.choice(DECLARED[language]).format(n=rng.choice(["Ab", "cd", "_e", "Fg"])) if rng.random() < 0.4 else rng.choice(PARTS[symbols.PROFILES[language][0]])
                lines.append(rng.choice(["", "", "  ", "    ", "\t", " "]) + part)
            made[f"{language}{n}.{suffix}"] = (language, rng.choice(["\n", "\r\n"]).join(lines))
    made["deep.ts"] = ("TypeScript", "class A {\n" * 3000 + "}\n" * 2999)
    _, files = corpus(spark, {"r": {path: text for path, (_, text) in made.items()}})
    got = {}
    for r in symbols.extract_symbols(files).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.name, r.kind, r.parent))
    made.pop("deep.ts")
    deep = sorted(got.pop("deep.ts"))
    assert [(s, e) for s, e, *_ in deep] == [(1, 1)] + [(n, 6001 - n) for n in range(2, 3001)]
    assert sum(map(len, got.values())) > 2000
    for path, (language, text) in made.items():
        assert sorted(got.get(path, []), key=str) == _plain_symbols(text, language), (path, text)


def test_symbols_of_the_code_view(spark):
    files = view(spark, "/root/testdata/sf0.001", "code_files")
    contents = [(r.repo_id, r.path, r.content) for r in files.select("repo_id", "path", "content").collect()]
    got = {}
    for r in symbols.extract_symbols(files).collect():
        got.setdefault((r.repo_id, r.path), []).append((r.start_line, r.end_line, r.name, r.kind, r.parent))
    language_of = {suffix: language for language, suffix in SUFFIX.items()}
    want = {(repo, path): _plain_symbols(text, language_of[path.rsplit(".", 1)[-1]]) for repo, path, text in contents if path.rsplit(".", 1)[-1] in language_of}
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_symbols_keep_a_file_in_one_row(spark):
    _, files = corpus(spark, {"r": {"a.py": PY}})
    plan = symbols.extract_symbols(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_brace_depth_by_hand(spark):
    _, files = corpus(spark, {"r": {"a.ts": "{\n}}\n'{' {{ // {\n", "b.md": "{"}})
    depths = rows(symbols.brace_depth(symbols.line_facts(files)), "path", "line", "depth_before", "depth_after")
    assert depths == [("a.ts", 1, 0, 1), ("a.ts", 2, 1, -1), ("a.ts", 3, -1, 1), ("a.ts", 4, 1, 1)]
