"""Whole-audit results worked out by hand from the rules."""

import pytest
from helpers import corpus, rows

from gatewright.plans import audit as plan

REPOS = {
    "g1": {"README": "Hello world!\n"},
    "g2": {"package.json": '{"name": "minimal", "version": "0.0.1"}', "src/index.ts": "export const x = 1;\n"},
    "g3": {"package.json": '{"name": "no-readme"}', "src/index.ts": "export const y = 2;\n"},
}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    tree, files = corpus(spark, REPOS)
    return plan.audit(tree, files, folder=str(tmp_path_factory.mktemp("audit") / "run"))


def test_scores(result):
    got = {r["repo_id"]: r for r in result.scores.collect()}
    g1 = got["g1"]
    assert (g1.documentation, g1.reproducibility, g1.securityHygiene, g1.deploymentReadiness, g1.overall) == (
        37.5, 28.5, 95.0, 63.5, 53.1,
    )
    g2 = got["g2"]
    assert (g2.documentation, g2.reproducibility, g2.securityHygiene, g2.deploymentReadiness, g2.overall) == (
        5.5, 28.5, 95.0, 58.5, 42.7,
    )
    assert got["g3"].overall == 42.7


def test_blockers(result):
    ids = {}
    for repo, fid in rows(result.blockers, "repo_id", "id"):
        ids.setdefault(repo, set()).add(fid)
    assert ids["g1"] == {"doc-license", "repro-no-lockfile", "hack-no-demo", "hack-no-license"}
    assert ids["g2"] == ids["g1"] | {"doc-readme"}


def test_gate(result):
    failing = {}
    for repo, cid, status in rows(result.checks, "repo_id", "check_id", "status"):
        if status == "fail":
            failing.setdefault(repo, []).append(cid)
    # The medium CI finding is in none of the five lists the gate reads.
    assert failing["g1"] == ["repository.license"]
    assert failing["g2"] == ["repository.license", "repository.readme"]


def test_reports(result):
    got = {r["repo_id"]: r for r in plan.reports(result).collect()}
    assert got["g1"].documentation_gaps_count == 8
    assert got["g1"].blockers_list_count == 4
    listed = [r for r in plan.report_sections(result).collect() if r.repo_id == "g1"]
    assert sum(r.section == "blockers" for r in listed) == 4
    assert sum(r.section == "documentation_gaps" for r in listed) == 8
    assert got["g1"].status == "blocked" and not got["g1"].ship
    assert len(got["g1"].checklist) == 9
