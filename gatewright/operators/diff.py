"""What changed between two audits of the same repositories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewright.functions.patterns import RULES as D
from gatewright.functions.numbers import round1
from gatewright.operators.findings import finding_key, first_file, first_line, rule_of, severity_rank


def fixable_findings(lists: DataFrame) -> DataFrame:
    """First occurrence per (repo, id) over lists tagged ``list_ord`` (blockers, documents, security)."""
    rest = [c for c in lists.columns if c not in ("repo_id", "id")]
    usable = [c for c in rest if c not in ("verification",)]
    order = F.struct("list_ord", "ord", severity_rank(F.col("severity")), first_file(), first_line())
    first = F.min_by(F.struct(*usable), order)
    return lists.groupBy("repo_id", "id").agg(first.alias("f")).select("repo_id", "id", "f.*")


def score_deltas(base: DataFrame, head: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Overall and per-dimension deltas with the verdict, per (repo, target).

    A pair found in one audit only keeps its row: null deltas, verdict ``added`` or ``removed``.
    """
    names = ["overall", *D.DIMENSIONS]
    b = base.select("repo_id", "target", *[F.col(n).alias(f"base_{n}") for n in names])
    h = head.select("repo_id", "target", *[F.col(n).alias(f"head_{n}") for n in names])
    joined = b.withColumn("_b", F.lit(True)).join(h.withColumn("_h", F.lit(True)), ["repo_id", "target"], "full_outer")
    deltas = [round1(F.col(f"head_{n}") - F.col(f"base_{n}")).alias(f"{n}_delta") for n in names]
    sided = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed")
    return joined.select("repo_id", "target", *deltas, sided.alias("_side")).select(
        "repo_id",
        "target",
        *[f"{n}_delta" for n in names],
        F.coalesce("_side", diff_verdict(F.col("overall_delta"), epsilon)).alias("verdict"),
    )


def diff_verdict(delta, epsilon: float = 0.0):
    return F.when(delta > epsilon, "improved").when(delta < -epsilon, "regressed").otherwise("unchanged")


def rule_deltas(base: DataFrame, head: DataFrame) -> DataFrame:
    """Per (repo, dimension, rule) the change of its delta; unchanged rules are dropped."""
    keys = ["repo_id", "dimension", "rule"]
    b = base.select(*keys, F.col("delta").alias("before"), F.col("reason").alias("before_reason"))
    h = head.select(*keys, F.col("delta").alias("after"), F.col("reason").alias("after_reason"))
    joined = b.join(h, keys, "full_outer")
    before, after = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return joined.select(
        *keys,
        before.alias("before"),
        after.alias("after"),
        round1(after - before).alias("delta"),
        F.coalesce("after_reason", "before_reason").alias("reason"),
    ).where(F.col("delta") != 0)


def _by_key(findings: DataFrame) -> DataFrame:
    """One row per (repo, key); on a key collision the last in list order wins."""
    rule = F.coalesce("rule_id", rule_of(F.col("id"))["rule_id"])
    rows = findings.select(
        "repo_id",
        finding_key(findings).alias("key"),
        "id",
        rule.alias("rule_id"),
        first_file().alias("file"),
        first_line().alias("line"),
        "severity",
    )
    last = F.max_by(
        F.struct("id", "rule_id", "file", "line", "severity"),
        F.struct(severity_rank(F.col("severity")), "id"),
    )
    return rows.groupBy("repo_id", "key").agg(last.alias("f")).select("repo_id", "key", "f.*")


def finding_status(base: DataFrame, head: DataFrame) -> DataFrame:
    """resolved / new / persistent per (repo, key); a changed severity stays persistent."""
    names = ["id", "rule_id", "file", "line", "severity"]
    b = _by_key(base).select("repo_id", "key", F.struct(*names).alias("b"))
    h = _by_key(head).select("repo_id", "key", F.struct(*names).alias("h"))
    joined = b.join(h, ["repo_id", "key"], "full_outer")
    status = F.when(F.col("h").isNull(), "resolved").when(F.col("b").isNull(), "new").otherwise("persistent")
    shown = F.coalesce("h", "b")
    return joined.select(
        "repo_id",
        "key",
        status.alias("status"),
        *[shown[n].alias(n) for n in names],
        F.col("b.severity").alias("base_severity"),
    )


def _pair(lines, resolved, fresh, reach: int) -> list[tuple[int, int, int]]:
    """Nearest-first one-to-one pairing of line counters, ties by from-line then to-line."""
    left = {a: n for a, n in zip(lines, resolved) if n}
    right = {b: n for b, n in zip(lines, fresh) if n}
    out = []
    for distance in range(reach + 1):
        for a in lines:
            if not left.get(a):
                continue
            for b in (a,) if distance == 0 else (a - distance, a + distance):
                n = min(left[a], right.get(b, 0))
                if n:
                    left[a] -= n
                    right[b] -= n
                    out.append((int(a), int(b), int(n)))
    return out


def moved_findings(status: DataFrame, reach: int = D.MAX_MOVE_DISTANCE) -> DataFrame:
    """Resolved and new findings of one rule and file, at most ``reach`` lines apart, paired greedily.

    Candidate pairs are never materialised.  A pairing only depends on how many
    findings sit on each line, so rows are first counted per line (map-side
    combine: any number of findings on one line is one row).  Lines further
    apart than ``reach`` cannot interact, so each file is cut into clusters at
    such gaps; a cluster without both sides is dropped.  What is left per
    cluster is at most one row per line of one file.
    """
    rows = status.where(F.col("status").isin("resolved", "new") & F.col("line").isNotNull())
    keys = ["repo_id", "rule_id", "file"]
    counted = rows.groupBy(*keys, "line").agg(
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") == "new").alias("fresh"),
    )
    by_line = Window.partitionBy(*keys).orderBy("line")
    gap = F.col("line") - F.lag("line").over(by_line) > reach
    clustered = counted.withColumn("starts", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "cluster", F.sum("starts").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    )
    part = Window.partitionBy(*keys, "cluster")
    both = (
        clustered.withColumn("r", F.sum("resolved").over(part))
        .withColumn("f", F.sum("fresh").over(part))
        .where((F.col("r") > 0) & (F.col("f") > 0))
        .select(*keys, "cluster", "line", "resolved", "fresh")
    )
    # Small clusters are packed into Arrow batches: one row per cluster.
    packed = both.groupBy(*keys, "cluster").agg(
        F.array_sort(F.collect_list(F.struct("line", "resolved", "fresh"))).alias("c")
    )

    @F.pandas_udf("array<struct<from_line:int,to_line:int,n:bigint>>")
    def pair(lines: pd.Series, resolved: pd.Series, fresh: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"from_line": a, "to_line": b, "n": n} for a, b, n in _pair(x.tolist(), r.tolist(), f.tolist(), reach)]
                for x, r, f in zip(lines, resolved, fresh)
            ],
            dtype=object,
        )

    get = lambda name: F.transform("c", lambda x: x[name])
    paired = packed.select(*keys, pair(get("line"), get("resolved"), get("fresh")).alias("p"))
    flat = paired.select(*keys, F.explode("p").alias("m"))
    return flat.select(
        *keys, "m.from_line", "m.to_line", F.explode(F.sequence(F.lit(1), F.col("m.n").cast("int"))).alias("_i")
    ).drop("_i")


def metrics_drift(metrics: DataFrame, baseline: DataFrame, names: list[str]) -> DataFrame:
    """Changed metrics of a run against a recorded baseline, null-safe.

    Both tables: (repo_id, history_scanned, <names>).  ``comparable`` is false
    unless both sides agree on whether history was scanned.
    """
    long = lambda df, v: df.unpivot(
        ["repo_id", "history_scanned"], names, "metric", v
    )
    a = long(baseline, "before").withColumnRenamed("history_scanned", "before_history")
    b = long(metrics, "after").withColumnRenamed("history_scanned", "after_history")
    joined = a.join(b, ["repo_id", "metric"], "full_outer")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).select(
        "repo_id",
        "metric",
        "before",
        "after",
        (F.col("after") - F.col("before")).alias("delta"),
        F.coalesce(F.col("before_history") & F.col("after_history"), F.lit(False)).alias("comparable"),
    )
