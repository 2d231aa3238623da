"""Operators return everything, hold no hidden limits and keep one-sided rows."""

import re
import time

from pyspark.sql import functions as F

from gatewright.functions import text as X
from gatewright.operators import admission, diff, gate, history, residue, scale
from gatewright.queries import catalogue, gates
from gatewright.sources.corpus import read_checkouts


def lines(spark, content, pattern):
    row = spark.createDataFrame([(content,)], "c string").select(
        X.match_lines(F.col("c"), pattern).alias("all"), X.first_match(F.col("c"), pattern).alias("first")
    )
    return row.collect()[0]


def test_match_lines_agree_with_python(spark):
    pattern = r"catch \{\s*\}"
    for n in (0, 1, 2, 255, 256, 257, 700):
        content = "x\n".join("catch {%s}" % ("\n" * (i % 3)) for i in range(n))
        expected = [content.count("\n", 0, m.start()) + 1 for m in re.finditer(pattern, content)]
        got = lines(spark, content, pattern)
        assert [m.line for m in got["all"]] == expected
        assert (got["first"].line if got["first"] else None) == (expected[0] if expected else None)


def test_match_lines_stay_linear(spark):
    content = "catch {}  // eleven\n" * 50_000
    start = time.time()
    got = lines(spark, content, r"catch \{\s*\}")
    assert len(got["all"]) == 50_000 and got["all"][-1].line == 50_000
    assert time.time() - start < 60


def test_running_total_over_sparse_positions(spark):
    rows = [("r", i * i * 1000, i % 7) for i in range(2000)] + [("q", 5, 3)]
    out = scale.running_total(spark.createDataFrame(rows, "repo_id string, pos long, v long"), ["repo_id"], "pos", "v", "t")
    got = {(r.repo_id, r.pos): r.t for r in out.collect()}
    total = 0
    for repo, pos, v in rows[:-1]:
        total += v
        assert got[repo, pos] == total
    assert got["q", 5] == 3 and len(got) == len(rows)


def test_files_and_hits_are_not_cut(spark):
    tree = spark.createDataFrame([("r", f"src/f{i}.ts", 2_000_000, i) for i in range(2500)], "repo_id string, path string, size long, list_pos long")
    assert admission.admitted(tree).count() == 2500
    assert admission.admitted(tree, max_files=7).count() == 7
    assert admission.cap_total_bytes(tree).where("NOT truncated").count() == 2500
    files = spark.createDataFrame([("r", "src/a.ts", 0, "try { x() } catch (e) {}\n" * 9)], "repo_id string, path string, list_pos long, content string")
    hits = residue.empty_catch(files)
    assert residue.residue_findings(hits).count() == hits.count() == 9
    assert residue.residue_findings(hits, limit=3).count() == 3


def test_cap_tells_what_it_leaves_out(spark):
    sizes = {"r": [40, 500, 30, 20, 20, 5], "q": [10, 20]}
    tree = spark.createDataFrame(
        [(repo, f"f{i}.md", size, i) for repo, some in sizes.items() for i, size in enumerate(some)], "repo_id string, path string, size long, list_pos long"
    )
    out = admission.cap_total_bytes(tree, max_total=100, max_file_bytes=400, marked=True)
    got = {(r.repo_id, r.path): (r.bytes_so_far, r.kept, r.truncated) for r in out.collect()}
    kept = [(40, True), (40, False), (70, True), (90, True), (110, False), (115, False)]
    want = {("r", f"f{i}.md"): (*x, True) for i, x in enumerate(kept)} | {("q", "f0.md"): (10, True, False), ("q", "f1.md"): (30, True, False)}
    assert got == want
    rows = catalogue.QUERIES["cap_total_bytes"](spark, "/root/testdata/sf0.01").collect()
    assert {r.kept for r in rows} == {True, False} and any(r.truncated for r in rows)


def test_history_keeps_commits_that_share_a_short_sha(spark):
    rows = [("r", "k", "a.env", f"reason{i}", "high", "abcdef1" + str(i) * 33, "s", None, 1) for i in (1, 2)]
    hits = spark.createDataFrame(
        rows, "repo_id string, kind string, file string, reason string, severity string, sha string, subject string, ts timestamp, line int"
    )
    assert history.history_findings(hits).count() == 2


def test_comparisons_keep_one_sided_repositories(spark):
    names = ["overall", *diff.D.DIMENSIONS]
    schema = "repo_id string, target string, " + ", ".join(f"{n} double" for n in names)
    base = spark.createDataFrame([("both", "t", *[50.0] * len(names)), ("gone", "t", *[50.0] * len(names))], schema)
    head = spark.createDataFrame([("both", "t", *[60.0] * len(names)), ("fresh", "t", *[50.0] * len(names))], schema)
    assert {r.repo_id: r.verdict for r in diff.score_deltas(base, head).collect()} == {"both": "improved", "gone": "removed", "fresh": "added"}
    verdict = "repo_id string, status string, ship boolean, blockers long, warnings long"
    before = spark.createDataFrame([("both", "blocked", False, 1, 0), ("gone", "pass", True, 0, 0)], verdict)
    after = spark.createDataFrame([("both", "pass", True, 0, 0), ("fresh", "blocked", False, 2, 0)], verdict)
    keys = spark.createDataFrame([("both", "k")], "repo_id string, key string")
    out = {r.repo_id: r for r in gate.compare_gates(before, after, keys, keys.where("false")).collect()}
    assert set(out) == {"both", "gone", "fresh"}
    assert out["both"].ship_changed and out["both"].resolved == 1 and out["both"].summary.startswith("Free to ship")
    assert out["gone"].after_ship is None and out["fresh"].before_ship is None


def test_read_checkouts(spark, tmp_path):
    for name, body in {"one/src/b.ts": b"let b = 1", "one/README.md": "# � é".encode(), "two/x.png": b"\x89PNG", "two/bad.md": b"a\xffb"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    tree, files = read_checkouts(spark, str(tmp_path))
    assert [tuple(r) for r in tree.orderBy("repo_id", "list_pos").collect()] == [
        ("one", "README.md", 8, 1), ("one", "src/b.ts", 9, 2), ("two", "bad.md", 3, 1), ("two", "x.png", 4, 2),
    ]
    assert {(r.repo_id, r.path): r.content for r in files.collect()} == {
        ("one", "README.md"): "# � é", ("one", "src/b.ts"): "let b = 1", ("two", "bad.md"): "a�b",
    }


def test_scores_take_all_severities(spark):
    small = "/root/testdata/sf0.001"
    weight = {"critical": 25.0, "high": 12.0, "medium": 5.0}
    dimension = {"documentation": "documentation", "reproducibility": "reproducibility", "security": "securityHygiene", "deployment": "deploymentReadiness"}
    groups, severities = {}, set()
    for r in gates._routed(spark, small).collect():
        if r.bucket in dimension:
            severities.add(r.severity)
            first = r.evidence[0].file if r.evidence else None
            groups.setdefault((r.repo_id, dimension[r.bucket], first, r.rule_id), []).append(weight.get(r.severity, 1.5))
    expected = {}
    for (repo, name, _, _), ws in groups.items():
        expected[repo, name] = expected.get((repo, name), 0) - sum(sorted(ws)[-3:])
    got = catalogue.QUERIES["score_rules"](spark, small).where("rule = 'severity-penalty'").collect()
    assert severities == {"critical", "high", "medium", "low"}
    assert {(r.repo_id, r.dimension): r.delta for r in got} == expected
