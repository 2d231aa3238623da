"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 40
POINTS = 64  # virtual nodes of a shard
SLICES = 256  # of an arc: rows are ranked slice by slice
CHUNK = 4096  # equal rows that are numbered in one go
OVERHEAD = 16  # bytes that a row counts beside its text
CELLS = 1 << 16  # positions on the ring


def position(name: Column) -> Column:
    """Where a string lies on the ring: the first 16 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 4), 16, 10).cast("int")


@dataclass(frozen=True)
class Ring:
    """The virtual nodes by position.  Arc i ends at node i, its home; what lies behind the last node is of arc 0."""

    positions: tuple[int, ...]
    owners: tuple[int, ...]

    @staticmethod
    def of(shards: int, points: int = POINTS) -> Ring:
        """The ring of shards 0 to `shards` - 1.  A shard's nodes do not depend on how many others there are."""

        def at(shard: int, node: int) -> int:
            return int(hashlib.sha256(f"shard {shard} node {node}".encode()).hexdigest()[:4], 16)

        nodes = sorted((at(s, n), s) for s in range(shards) for n in range(points))
        return Ring(tuple(p for p, _ in nodes), tuple(s for _, s in nodes))

    def arc(self, at: int) -> int:
        return bisect_left(self.positions, at) % len(self.positions)

    def cells(self, spark: SparkSession) -> DataFrame:
        """at, arc: the arc of each of the CELLS positions."""
        ends = [(-1, 0), *((p, i + 1) for i, p in enumerate(self.positions)), (CELLS - 1, 0)]
        spans = [(before + 1, at, arc % len(self.positions)) for (before, arc), (at, _) in zip(ends, ends[1:]) if at > before]
        table = spark.createDataFrame(spans, "first int, last int, arc int")
        return table.select(F.explode(F.sequence("first", "last")).alias("at"), "arc")


@dataclass(frozen=True)
class Piece:
    """Keys ranked [low, high) of an arc go to `shard`, into its slots from `slot` on."""

    arc: int
    low: int
    high: int
    shard: int
    slot: int


def place(ring: Ring, counts: Sequence[int], capacity: Sequence[int]) -> list[Piece]:
    """Where the keys of each arc go, if no shard takes more than its capacity.

    All keys start at the home node of their arc and a shard takes those waiting at its nodes, node by node in ring
    order and by rank within an arc, until it is full; all others step to the next node clockwise, and so on.  There
    are at most (arcs + shards) pieces, however many keys there are.
    """
    if sum(counts) > sum(capacity):
        raise ValueError("the shards together are too small")
    arcs, shards = len(ring.positions), len(capacity)
    left, used = list(capacity), [0] * shards
    done = [0] * arcs
    waiting = [a for a in range(arcs) if counts[a]]
    pieces: list[Piece] = []
    step = 0
    while waiting:
        still = []
        for node, a in sorted(((a + step) % arcs, a) for a in waiting):
            shard = ring.owners[node]
            take = min(left[shard], counts[a] - done[a])
            if take:
                pieces.append(Piece(a, done[a], done[a] + take, shard, used[shard]))
                done[a] += take
                left[shard] -= take
                used[shard] += take
            if done[a] < counts[a]:
                still.append(a)
        waiting = still
        step += 1
    return pieces


def even(rows: int, shards: int) -> list[int]:
    """Capacities that add up to `rows` and differ by at most one."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _ranked(keys: DataFrame, ring: Ring, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups of equal rows with their first rank within their arc, and the number of rows of each arc.

    Rows of an arc go by the MD5 of all their columns.  A rank is the number of rows in earlier slices of the arc,
    from the counts of all slices (a fixed number of them), plus the rank inside the slice.
    """
    text = F.concat_ws(":", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names))
    mixed = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    grouped = keys.groupBy(*names).agg(F.count("*").alias("copies"))
    spark = keys.sparkSession
    placed = grouped.join(F.broadcast(ring.cells(spark)), "at").withColumn("mixed", mixed)  # CELLS rows at every size
    placed = Scratch(spark).table(placed.withColumn("slice", (F.col("mixed") % SLICES).cast("int")), "keys")
    slices = placed.groupBy("arc", "slice").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("arc").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("arc", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("arc", "slice").orderBy("mixed", *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("rank", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    ranked = ranked.join(starts, ["arc", "slice"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select(*names, "arc", "rank", "copies"), slices.groupBy("arc").agg(F.sum("n").alias("n"))


def _copies(groups: DataFrame, names: list[str]) -> DataFrame:
    """A row for every copy, in chunks that are dealt out again, so that a hot group is not numbered in one task."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))
    dealt = groups.withColumn("chunk", F.explode(chunks)).repartition("arc", "rank", "chunk")
    first = F.col("chunk") * CHUNK
    within = F.sequence(first, F.least(first + CHUNK, F.col("copies")) - 1)
    return dealt.withColumn("copy", F.explode(within)).select(*names, "arc", (F.col("rank") + F.col("copy")).alias("rank"))


def assign(rows: DataFrame, key: Column, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """The rows with `shard` and `slot`: every shard gets floor or ceiling of (rows / shards) of them.

    `key` (a string) places a row on the ring; null counts as the empty string.  A row lands at the first node
    clockwise whose shard is not full.  Loads are bounded by the even share, so balance is exact, and because a
    shard's nodes stay where they are and ranks depend on the rows alone, a change in rows or shards moves only
    overflow.  Equal keys with other columns are spread by those; equal rows are counted before they travel and
    numbered in chunks.  The driver sees one number for each arc of the ring.
    """
    spark = rows.sparkSession
    names = [*rows.columns, "at"]
    ring = Ring.of(shards, points)
    keyed = rows.withColumn("at", position(F.coalesce(key, F.lit(""))))
    groups, counted = _ranked(keyed, ring, names)
    counts = [0] * len(ring.positions)
    for arc, n in counted.collect():
        counts[arc] = n
    pieces = place(ring, counts, even(sum(counts), shards))
    table = spark.createDataFrame(
        [(p.arc, p.low, p.high, p.shard, p.slot) for p in pieces],
        "arc int, low long, high long, shard int, base long",
    )
    # At most (arcs + shards) pieces, so they may be broadcast.
    found = _copies(groups, names).join(F.broadcast(table), "arc").where("low <= rank AND rank < high")
    return found.select(*rows.columns, "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null): one row per input row.

    Size is the UTF-8 bytes of the text plus 16 and text_crc32 their CRC-32; null text has no bytes.  The doc_id places
    a row on the ring; a null doc_id counts as an empty key.  Numbers of rows differ by at most one between shards and
    slots count from 0 in each.  Repeated rows come back as often as they are there; other columns are not read; an
    empty table gives no rows.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    out = assign(rows, F.col("doc_id").cast("string"), shards, points)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def balance(assigned: DataFrame) -> DataFrame:
    """shard, rows, bytes, first_slot, last_slot of an assignment."""
    totals = [F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")]
    return assigned.groupBy("shard").agg(*totals)
