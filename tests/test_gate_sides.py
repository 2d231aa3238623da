"""Two audits through the gate in one pass, and the keys of their findings."""

import datetime

import pytest
from gatewright.functions import text as X
from gatewright.operators import gate
from gatewright.queries import catalogue, gates
from pyspark.sql import functions as F

SCHEMA = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Line items of nine repositories, with repeated rows and with null order, part, supplier and line numbers."""
    day = datetime.datetime(2024, 1, 1)
    rows = [
        (o, (o * 13 + n * 5) % 90, (o * 7 + n * 11) % 60, n, float(n + o % 3), 1.0, 0.0, 0.0, "ARN"[(o + n) % 3], "O", day)
        for o in range(80)
        for n in range(1, 8)
        if o < 40 or (o % 10 == 0 and n < 4)
    ]
    # One more has a blocker in the base and none in the head.
    rows += [(800, 2, 2, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day), (800, 3, 9, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day)]
    for column in range(4):
        rows += [tuple(None if i == column else v for i, v in enumerate(r)) for r in rows[column:200:17]]
    folder = tmp_path_factory.mktemp("sides")
    spark.createDataFrame(rows + rows[::3], SCHEMA).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _one_by_one(spark, d):
    sides = []
    for n in (0, 1):
        found = gate.gate_findings(gates._enriched(spark, d, n))
        checks = gate.gate_checks(found.select("repo_id").distinct(), found)
        sides.append((gate.gate_verdict(checks), gate.blocking_keys(checks, found)))
    (before, before_keys), (after, after_keys) = sides
    return gate.compare_gates(before, after, before_keys, after_keys)


def test_both_sides_in_one_pass_are_those_of_two(spark, lines):
    got = catalogue.QUERIES["compare_gates"](spark, lines)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, _one_by_one(spark, lines).select(*got.columns).collect()), key=str)
    assert len({r[0] for r in rows}) == 10 and any(r[5] for r in rows) and any(r[6] for r in rows)
    # The findings were read and keyed once: what is left reads the stored tables alone.
    assert not [path for path in got.inputFiles() if "lineitem" in path]


def test_keys_of_a_batch_are_those_of_single_texts(spark):
    texts = ["SEC-SECRET-001|src/a.ts:1", "", None, "é|ß:-", "𝔘|a:2", "x" * 5000, "|", "b\u0000c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = rows.select("t", X.fnv1a64_pairs(F.col("t")).alias("batch"), X.fnv1a64_pair(F.col("t")).alias("single")).collect()
    assert [r.batch for r in got] == [r.single for r in got] and [r.t for r in got] == texts
    assert got[2].batch is None and len({r.batch for r in got}) == len(texts)
    for plain in (["abc", "a"], [], [None, ""]):
        rows = spark.createDataFrame([(t,) for t in plain], "t string").coalesce(1)
        got = rows.select(X.fnv1a64_pairs(F.col("t")).alias("batch"), X.fnv1a64_pair(F.col("t")).alias("single"))
        assert all(r.batch == r.single for r in got.collect())


def test_the_longest_prefix_gives_the_rule(spark):
    from gatewright import dims
    from gatewright.operators.findings import rule_of

    ids = [k + "x" for k in dims.PREFIX_RULES] + [*dims.PREFIX_RULES, *dims.EXACT_RULES, "", "nothing of these", None]

    def expected(fid):
        if fid in dims.EXACT_RULES:
            return dims.EXACT_RULES[fid][0]
        held = [k for k in dims.PREFIX_RULES if fid is not None and fid.startswith(k)]
        return dims.PREFIX_RULES[max(held, key=len)][0] if held else "UNMAPPED"

    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", rule_of(F.col("id"))["rule_id"].alias("rule"))
    for r in rows.collect():
        assert (r.rule is None) if r.id is None else r.rule.startswith(expected(r.id))
