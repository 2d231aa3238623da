"""Prioritised fix plans from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import text as X
from gatewright.operators.findings import effort, first_file, severity_rank
from gatewright.operators.scale import top_k


def fix_plan_candidates(fixable: DataFrame, limit: int | None = None) -> DataFrame:
    """Worst finding per (rule, file), ranked per repository; with ``limit`` the first of them.

    The first step is an aggregate (min of an ordered struct), so a rule that
    fires everywhere in one file is combined before the shuffle.
    """
    rank = severity_rank(F.col("severity"))
    rest = [c for c in fixable.columns if c not in ("repo_id", "verification")]
    group = [F.coalesce("rule_id", "id").alias("group_rule"), first_file().alias("group_file")]
    best = F.min_by(F.struct(*rest), F.struct(rank, F.collate("id", "UNICODE"), F.col("id")))
    worst = (
        fixable.select("repo_id", *rest, *group)
        .groupBy("repo_id", "group_rule", "group_file")
        .agg(best.alias("f"))
        .select("repo_id", "f.*")
    )
    order = [severity_rank(F.col("severity")), F.collate("id", "UNICODE"), F.col("id")]
    return top_k(worst, ["repo_id"], order, limit, rank="plan_ord")


def fix_priority(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "P0").when(severity == "medium", "P1").otherwise("P2")


def _sentence(text: Column, limit: int | None = None) -> Column:
    """Whole text when short; else cut at the last sentence end, or with an ellipsis."""
    flat = F.regexp_replace(X.strip_space(text), X.SPACE + "+", " ")
    if limit is None:
        return flat
    cut = F.substring(flat, 1, limit)
    # Greedy match up to the last ". " or "; ".
    head = F.regexp_extract(cut, r"(?s)\A(.*[.;]) ", 1)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.when(F.length(head) > D.WHY_MIN_BOUNDARY + 1, head).otherwise(F.concat(cut, F.lit("...")))
    )


def derive_test_path(file: Column, category: Column, language: Column) -> Column:
    base = F.substring_index(file, "/", -1)
    stem = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*\z", "")).otherwise(base)
    areas = F.create_map(*[F.lit(x) for kv in D.CATEGORY_TEST_AREA.items() for x in kv])
    area = F.element_at(areas, category)
    path = (
        F.when(language == "Solidity", F.concat(F.lit("test/"), stem, F.lit(".t.sol")))
        .when(language == "Python", F.concat(F.lit("tests/"), area, F.lit("/test_"), stem, F.lit(".py")))
        .otherwise(F.concat(F.lit("tests/"), area, F.lit("/"), stem, F.lit(".test.ts")))
    )
    return F.when(stem != "", path)


def fix_plans(candidates: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """``languages(repo_id, primary_language)`` picks the test-file convention."""
    if languages is None:
        rows = candidates.withColumn("primary_language", F.lit(None).cast("string"))
    else:
        rows = candidates.join(languages.select("repo_id", "primary_language"), "repo_id", "left")
    target = F.nullif(first_file(), F.lit(""))
    criteria = F.when(F.size("criteria") > 0, F.col("criteria")).otherwise(
        F.array(F.concat(F.lit("No longer reported: "), F.col("id")))
    )
    steps = F.concat(
        F.array(F.struct(F.lit(1).alias("order"), F.col("action").alias("action"), target.alias("target"))),
        F.transform(
            criteria, lambda c, i: F.struct((i + 2).alias("order"), c.alias("action"), target.alias("target"))
        ),
    )
    test = derive_test_path(target, F.col("category"), F.coalesce("primary_language", F.lit("")))
    severity = F.col("severity")
    first_reason = F.coalesce(F.get("evidence", F.lit(0))["reason"], F.lit(""))
    return rows.select(
        "repo_id",
        "plan_ord",
        F.concat(F.lit("fixplan:"), F.col("id")).alias("plan_id"),
        F.col("id").alias("finding_id"),
        fix_priority(severity).alias("priority"),
        effort(severity).alias("effort"),
        F.lit("open").alias("status"),
        "title",
        _sentence(F.concat(F.col("title"), F.lit(". "), first_reason)).alias("why"),
        "evidence",
        steps.alias("steps"),
        F.array_compact(F.array(test)).alias("tests_to_add"),
        criteria.alias("criteria"),
        F.concat(F.lit("Change in area: "), F.col("category")).alias("risk"),
    )
