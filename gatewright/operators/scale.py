"""Building blocks that keep one hot repository from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None = None, rank: str = "rank") -> DataFrame:
    """All rows with their rank per key; with ``k`` the first ``k`` of each key.

    With ``k`` Spark's group limit cuts every key in the map tasks.  A rank that nobody reads costs nothing: the
    optimizer drops the window.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def running_total(df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, blocks: int = 256) -> DataFrame:
    """Inclusive running sum of ``value`` in ``position`` order, per key.

    Two levels: each key is cut into at most ``blocks`` blocks at approximate quantiles of its own positions, so the
    blocks are even however sparse the positions are; a running sum over the block totals, then one inside each
    block.  No window holds a whole key.  Where the cuts fall does not change the sums.  ``position`` must be unique
    and numeric within a key.
    """
    shares = F.lit([i / blocks for i in range(1, blocks)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(position, shares, 10_000).alias("_cuts"))
    blocked = df.join(cuts, list(keys)).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(position)))).drop("_cuts")
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.sum(value).over(inside))
        .drop("_block", "_offset")
    )


def bounded_values(df: DataFrame, column: str, limit: int) -> list:
    """Values of a small dimension, fetched only after proving that it is small."""
    rows = df.select(column).distinct().take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{column}: more than {limit} distinct values; this dimension must be small")
    return sorted(r[0] for r in rows)
