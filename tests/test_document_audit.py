"""The audit of the document corpus: its repositories' scores follow from its own findings and facts."""

from gatewright import dims as D
from gatewright.plans import audit as plan
from gatewright.queries import catalogue
from gatewright.queries.registry import view

SMALL = "/root/testdata/sf0.001"


def test_document_audit(spark, tmp_path):
    rows = view(spark, SMALL, "doc_files")
    result = plan.audit(rows.select("repo_id", "path", "size", "list_pos"), rows.select("repo_id", "path", "content"), folder=str(tmp_path / "run"))
    rules, weights = {}, D.TARGET_WEIGHTS["open_source"]
    for r in result.score_rules.collect():
        rules[r.repo_id, r.dimension] = rules.get((r.repo_id, r.dimension), 0.0) + r.delta
    found = {}
    for f in result.findings.select("repo_id").collect():
        found[f.repo_id] = found.get(f.repo_id, 0) + 1
    got = catalogue.QUERIES["document_audit"](spark, SMALL).collect()
    assert {r.repo_id for r in got} == {r.repo_id for r in rows.select("repo_id").distinct().collect()}
    for r in got:
        scores = {d: max(0.0, min(100.0, int((100 + rules.get((r.repo_id, d), 0.0)) * 10 + 0.5) / 10)) for d in D.DIMENSIONS}
        assert {d: r[d] for d in D.DIMENSIONS} == scores
        assert abs(r.overall - sum(scores[d] * weights[d] for d in D.DIMENSIONS)) <= 0.051
        assert r.findings == found.get(r.repo_id) and r.ship == (r.status != "blocked")
