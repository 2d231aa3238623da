"""Reports, tasks and moves of a whole audit, put together again from its parts in plain Python."""

import random
import re
from collections import Counter

import pytest
from helpers import corpus, rows
from pyspark.sql import functions as F

from gatewright import dims as D
from gatewright.operators import findings as fm
from gatewright.operators import history, secrets
from gatewright.plans import audit as plan
from gatewright.queries import catalogue, gates
from gatewright.queries.registry import view

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    tree, files = view(spark, SMALL, "tree"), view(spark, SMALL, "files")
    return plan.audit(tree, files, targets=tuple(D.TARGET_WEIGHTS), folder=str(tmp_path_factory.mktemp("audit") / "run"))


@pytest.fixture(scope="module")
def parts(result):
    tables = {n: getattr(result, n).collect() for n in ("facts", "findings", "fixtures", "blockers", "scores", "verdict")}
    assert all(tables.values())
    return tables


def plain_tasks(parts):
    effort = {"critical": "L", "high": "M"}
    out = Counter()
    for b in parts["blockers"]:
        out[b.repo_id, b.blocker_ord, f"task-{b.id}", effort.get(b.severity, "S"), (b.id,)] += 1
    per_repo = Counter(b.repo_id for b in parts["blockers"])
    for f in parts["facts"]:
        if f.has_contracts and not f.has_contract_tests:
            out[f.repo_id, per_repo[f.repo_id] + 1, "task-add-contract-tests", "L", ("web3-no-contract-tests",)] += 1
        if not f.hack_demo_url:
            out[f.repo_id, per_repo[f.repo_id] + 2, "task-add-demo-url", "M", ("hack-no-demo",)] += 1
    return out


def test_blockers_are_the_severe_findings_in_order(result, parts):
    rank = {"critical": 0, "high": 1}
    severe = [r for r in result.routed.collect() if r.severity in rank and r.bucket in fm.BLOCKER_LISTS]
    severe.sort(key=lambda r: (r.repo_id, rank[r.severity], fm.BLOCKER_LISTS.index(r.bucket), r.ord, r.id))
    want, n = [], Counter()
    for r in severe:
        n[r.repo_id] += 1
        want.append((r.repo_id, n[r.repo_id], r.id))
    assert sorted((b.repo_id, b.blocker_ord, b.id) for b in parts["blockers"]) == sorted(want)


def test_recommended_tasks(result, parts):
    got = fm.recommended_tasks(result.blockers, result.facts).collect()
    assert Counter((r.repo_id, r.task_ord, r.task_id, r.effort, tuple(r.related)) for r in got) == plain_tasks(parts)


def test_report_sections(result, parts):
    names = {"doc": "documentation_gaps", "security": "security_findings", "quality": "quality_findings"}
    want = Counter((b.repo_id, "blockers", b.blocker_ord, b.id) for b in parts["blockers"])
    want += Counter((f.repo_id, "fixture_findings", f.ord, f.id) for f in parts["fixtures"])
    want += Counter((f.repo_id, names[f.section], f.ord, f.id) for f in parts["findings"] if f.section in names)
    got = plan.report_sections(result).collect()
    assert Counter((r.repo_id, r.section, r.ord, r.id) for r in got) == want


def test_reports_hold_what_their_sections_hold(result, parts):
    sections = Counter((r.repo_id, r.section) for r in plan.report_sections(result).collect())
    tasks, verdict = Counter(), {v.repo_id: v for v in parts["verdict"]}
    for key, n in plain_tasks(parts).items():
        tasks[key[0]] += n
    got = {(r.repo_id, r.target): r for r in plan.reports(result).collect()}
    assert set(got) == {(s.repo_id, s.target) for s in parts["scores"]}
    facts = {f.repo_id: f for f in parts["facts"]}
    for s in parts["scores"]:
        r = got[s.repo_id, s.target]
        assert (r.overall, r.status, r.ship) == (s.overall, verdict[s.repo_id].status, verdict[s.repo_id].ship)
        assert r.tasks_count == tasks[s.repo_id] and r.blockers_list_count == sections[s.repo_id, "blockers"]
        assert len(r.checklist) == 9 + facts[s.repo_id].has_contracts
        done = {c["item"]: c["done"] for c in r.checklist}
        assert done["check-readme"] == facts[s.repo_id].has_readme and done["check-ci"] == facts[s.repo_id].has_ci
        assert done["check-blockers"] == (r.blockers_list_count == 0)
        for name in ("documentation_gaps", "security_findings", "quality_findings", "fixture_findings"):
            assert r[f"{name}_count"] == sections[s.repo_id, name]
        assert r.limitations[0] == "Files were read, nothing in them was run."


def test_moves_of_the_findings_view(spark):
    status = gates.diff.finding_status(gates._enriched(spark, SMALL, 0), gates._enriched(spark, SMALL, 1))
    sides = {}
    for r in status.where("status <> 'persistent' AND line IS NOT NULL").collect():
        sides.setdefault((r.repo_id, r.rule_id, r.file), ([], []))[r.status == "new"].append(r.line)
    want = Counter()
    for key, (gone, fresh) in sides.items():
        gone, fresh = list(gone), list(fresh)
        while pairs := [(abs(a - b), a, b) for a in gone for b in fresh if abs(a - b) <= 50]:
            _, a, b = min(pairs)
            gone.remove(a)
            fresh.remove(b)
            want[*key, a, b] += 1
    got = catalogue.QUERIES["moved_findings"](spark, SMALL).collect()
    assert Counter((r.repo_id, r.rule_id, r.file, r.from_line, r.to_line) for r in got) == want and len(want) > 50


def test_listing_answers_need_no_contents(spark):
    plan_text = catalogue.QUERIES["required_docs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" in plan_text and "documents" not in plan_text


def test_literals_occur_in_every_match(spark):
    """A line that a rule's pattern matches passes the test of the rule's literals."""
    rng = random.Random(3)
    bits = [
        "AK" + "IA", "gh" + "p_", "gh" + "r_", "sk_" + "live_", "-----BEGIN ", "RSA ", "PRIVATE KEY", "postgres", "mongodb+srv", "://", "u:p@h", "PassWord",
        "passwd", "PWD", "='", "\"", ": '", "'", "A1B2C3D4E5F6G7H8", "abcdefghij0123456789ABCDEFGHIJKLMNOP", "12345678", "12345678:", "abcdefghij0123456789ABCDEFGHIJKLMNO", ":", " ", "x", "/", "@",
    ]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(20_000)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    passed = {r.id for r in table.where(secrets.candidate_file(F.col("text"))).collect()}
    patterns = [re.compile(rule[3], re.ASCII) for rule in D.SECRET_RULES]
    token = re.compile(secrets.token_pattern())
    hit = [i for i, t in enumerate(texts) if any(p.search(t) for p in patterns) or token.search(t)]
    assert len(hit) > 300 and set(hit) <= passed
    assert {next(n for n, p in enumerate(patterns) if p.search(t)) for t in texts if any(p.search(t) for p in patterns)} >= {0, 1, 2, 3, 4, 5, 6}


def test_recovery_phrases_in_history(spark):
    words = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("nd", "rt", "st")][:100]
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    phrase = " ".join(words[:12])
    dictionary = "\n".join("+" + " ".join(words[n : n + 12]) for n in range(0, 84, 12))
    data = [
        ("r", "a" * 40, "keep it safe", None, "notes.md", f"@@ -1 +1,2 @@\n+the phrase is {phrase} and more\n-{phrase}\n ctx"),
        ("r", "b" * 40, "too short", None, "other.md", "@@ -1 +1 @@\n+" + " ".join(words[:11])),
        ("r", "c" * 40, "the list", None, "words.txt", "@@ -0,0 +1,7 @@\n" + dictionary),
    ]
    commits = spark.createDataFrame(data, "repo_id string, sha string, subject string, ts timestamp, filename string, patch string")
    hits = history.history_secret_hits(commits, wordlist=listed)
    assert rows(hits, "file", "kind", "line") == [("notes.md", "mnemonic", 1)]
    assert history.history_secret_hits(commits).count() == 0


def test_word_runs_and_shares(spark):
    listed = spark.createDataFrame([(w,) for w in ("able", "baker", "charlie")], "word string")
    _, files = corpus(spark, {"r": {"a.txt": "able baker\ncharlie, able " * 20, "b.txt": "able nothing else here\n" * 20, "c.txt": ""}})
    shares = {r.path: (r.words, r.known_share) for r in secrets.word_shares(files, listed).collect()}
    assert shares == {"a.txt": (80, 1.0), "b.txt": (80, 0.25), "c.txt": (0, None)}
    assert [r.path for r in secrets.wordlist_files(files, listed).collect()] == ["a.txt"]
    assert sorted(r.path for r in secrets.without_word_lists(files, listed).collect()) == ["b.txt", "c.txt"]
