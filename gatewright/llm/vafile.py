"""Exact top-k search by inner product over a vector-approximation file.

The first file holds one byte a component: the cell it falls into.  Scanning it gives an upper and a lower bound of
every score.  The exact vectors are then read in the order of their bounds, best first, until no vector left can
reach the kth score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

CELLS = 64
BLOCK = 2048
QUERY_BLOCK = 1024
QUERY_CHUNK = 128
LANES = 64
LANE_BLOCKS = 64
OPEN_BLOCKS = 4


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * component) of every vector without null, NaN or infinite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")
    )


def cell_limits(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest value of each component, by vector length; as many numbers as vectors have components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for size, block in _by_length(batch.column(0)):
                low, high = block.min(axis=0), block.max(axis=0)
                if size in held:
                    low, high = np.minimum(low, held[size][0]), np.maximum(high, held[size][1])
                held[size] = [low, high]
        for size, (low, high) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(low), pa.array(high)],
                names=["size", "at", "low", "high"],
            )

    found = vectors.where(F.size("v") > 0).select("v").mapInArrow(run, "size int, at int, low long, high long")
    rows = found.groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("size", "at").collect()
    limits: dict[int, tuple[list, list]] = {0: ([], [])}
    for r in rows:
        low, high = limits.setdefault(r.size, ([], []))
        low.append(r.low)
        high.append(r.high)
    return {size: (np.array(a, np.int64), np.array(b, np.int64)) for size, (a, b) in limits.items()}


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, matrix) for the vectors of a batch."""
    sizes = vectors.value_lengths().to_numpy()
    for size in np.unique(sizes):
        rows = vectors.filter(pa.array(sizes == size))
        yield int(size), rows.flatten().to_numpy().reshape(len(rows), int(size))


class Cells:
    """Equal-width cells of one vector length.  Cell c of a component holds the integers low + c * width and up."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> None:
        self.low, self.high = low, high
        self.width = (high - low) // cells + 1

    def code(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bottom = self.low + codes.astype(np.int64) * self.width
        return bottom.astype(float), np.minimum(bottom + self.width - 1, self.high).astype(float)

    def slack(self, queries: np.ndarray) -> float:
        """What rounding may add to a bound: nothing while all sums are exact in a double."""
        if not queries.size:
            return 0.0
        largest = float(np.abs(queries).max()) * float(np.maximum(np.abs(self.low), np.abs(self.high)).max()) * queries.shape[1]
        return largest * 2.0**-48 if largest >= 2.0**52 else 0.0

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products, a row for each query."""
        bottom, top = self.edges(codes)
        plus, minus = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        slack = self.slack(queries)
        return plus @ bottom.T + minus @ top.T - slack, plus @ top.T + minus @ bottom.T + slack


def _blocks(keyed: DataFrame, names: list[str], rows: int, code: dict[int, Cells] | None) -> DataFrame:
    """size, keys, data: the vectors v in blocks of one length, with a row of the long columns `names` for each; cells
    if `code`, else int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in waiting[size]])
            data = np.concatenate([d for _, d in waiting.pop(size)])
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([keys.tobytes()]), pa.array([data.tobytes()])],
                names=["size", "keys", "data"],
            )

        for batch in batches:
            keys, vectors = np.stack([batch.column(n).to_numpy() for n in names], axis=1), batch.column("v")
            sizes = vectors.value_lengths().to_numpy()
            for size, matrix in _by_length(vectors):
                own = keys[sizes == size]
                data = code[size].code(matrix) if code else matrix.astype(np.int64)
                for at in range(0, len(own), rows):
                    waiting.setdefault(size, []).append((own[at : at + rows], data[at : at + rows]))
                    if sum(len(k) for k, _ in waiting[size]) >= rows:
                        yield block(size)
        for size in list(waiting):
            yield block(size)

    return keyed.select(*names, "v").mapInArrow(run, "size int, keys binary, data binary")


def _best_items(best: np.ndarray, owners: np.ndarray, low: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best lower bounds of each query and their items, an item once: of those held and of a block's (an item a column)."""
    k = best.shape[1]
    if low.shape[1] > k:
        top = np.argpartition(low, low.shape[1] - k, axis=1)[:, -k:]
        low, items = np.take_along_axis(low, top, axis=1), items[top]
    low = np.concatenate((best, low), axis=1)
    items = np.concatenate((owners, np.broadcast_to(items, (len(best), low.shape[1] - k))), axis=1)
    order = np.argsort(-low, axis=1, kind="stable")
    low, items = np.take_along_axis(low, order, axis=1), np.take_along_axis(items, order, axis=1)
    again = np.tril(items[:, :, None] == items[:, None, :], -1).any(axis=2)
    top = np.argsort(np.where(again, np.inf, -low), axis=1, kind="stable")[:, :k]
    low = np.where(again, -np.inf, low)
    return np.take_along_axis(low, top, axis=1), np.take_along_axis(items, top, axis=1)


def _scan(pairs: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """query, key, owner, alone, low, high: for each query those vectors of the approximation file that its own bounds
    don't rule out.

    A task keeps the best lower bounds of k items for every query of the blocks it is working on and forgets a vector
    whose upper bound is below them, or, of a vector with one item, below another vector of that item in the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]] = {}

        def finish(number: int) -> Iterator[pa.RecordBatch]:
            names, best, _, found = work.pop(number)
            if found:
                at, keys, low, high = (np.concatenate(c) for c in zip(*found))
                live = high >= best[at].min(axis=1)
                columns = [names[at[live]], *keys[live].T, low[live], high[live]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c)) for c in columns], names=["query", "key", "owner", "alone", "low", "high"]
                )

        for batch in batches:
            for number, size, names, queries, keys, data in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if number not in work:
                    while len(work) >= OPEN_BLOCKS:
                        yield from finish(next(iter(work)))
                    own = np.frombuffer(names, np.int64)
                    work[number] = own, np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64), []
                own, best, owners, found = work[number]
                matrix = np.frombuffer(queries, np.int64).reshape(len(own), size)
                block = np.frombuffer(keys, np.int64).reshape(-1, 3)
                block = block[order := np.argsort(block[:, 1], kind="stable")]
                codes = np.frombuffer(data, np.uint8).reshape(len(block), size)[order]
                items, first, item = np.unique(block[:, 1], return_index=True, return_inverse=True)
                for at in range(0, len(own), QUERY_CHUNK):
                    part = slice(at, at + QUERY_CHUNK)
                    low, high = cells[size].bounds(matrix[part], codes)
                    of_item = low if len(items) == len(block) else np.maximum.reduceat(low, first, axis=1)
                    best[part], owners[part] = _best_items(best[part], owners[part], of_item, items)
                    live = high >= best[part].min(axis=1)[:, None]
                    if len(items) < len(block):
                        live &= (high >= of_item[:, item]) | (block[:, 2] == 0)
                    q, v = np.nonzero(live)
                    found.append((q + at, block[v], low[q, v], high[q, v]))
        for number in list(work):
            yield from finish(number)

    return pairs.select("number", "size", "names", "queries", "keys", "data").mapInArrow(
        run, "query long, key long, owner long, alone long, low double, high double"
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int = 5, cells: int = CELLS, first_read: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every query by exact inner product.

    `vectors` has vec_id and v (integers).  Ties go to the smaller vec_id; a query has fewer rows if there are fewer
    other vectors of its length (vectors of other lengths are no candidates).  Equal vectors are searched once, and of
    each such group only the k + 1 smallest ids can matter, so a vector that a third of the rows share is as cheap as
    any other.  A vec_id on several rows is one item with several vectors, of which the best counts; a repeated row
    adds nothing.  A score beyond a long is an error.  An empty table gives no rows.

    Query blocks meet blocks of the approximation file lane by lane; a lane holds about LANE_BLOCKS blocks, so there
    are as many lanes as the file needs.  Scores, candidates and queries stay
    distributed, and only the cell limits (two numbers a component) reach the driver.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    keep = k + 1
    rows = vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks")).groupBy("v", "vec_id").agg(F.max("asks").alias("asks"))
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= keep)
    distinct = scratch.table(
        few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.monotonically_increasing_id()),
        "vectors",
    )
    asking = rows.where("asks").select("vec_id", "v")
    queries = scratch.table(asking.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")

    grid = {size: Cells(low, high, cells) for size, (low, high) in cell_limits(distinct).items()}
    owned = distinct.select("key", F.col("ids")[0].alias("owner"), (F.size("ids") == 1).cast("long").alias("alone"), "v")
    file = scratch.table(_blocks(owned, ["key", "owner", "alone"], BLOCK, grid), "cells")
    held = file.count()
    lanes = max(1, min(held, LANES), -(-held // LANE_BLOCKS))
    file = file.withColumn("lane", F.pmod(F.xxhash64("keys"), F.lit(lanes)).cast("int"))
    blocks = _blocks(queries, ["query"], QUERY_BLOCK, None)
    blocks = scratch.table(
        blocks.select("size", F.col("keys").alias("names"), F.col("data").alias("queries"), F.monotonically_increasing_id().alias("number")),
        "query-blocks",
    )
    asked = blocks.select("size", "number", "names", "queries", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    bounds = _scan(asked.join(file.hint("merge"), ["size", "lane"]), grid, keep)
    # Items that differ count towards the floor: of each smallest id the vector with the best lower bound.
    own, item = Window.partitionBy("query"), Window.partitionBy("query", "owner")
    led = bounds.repartition("query").withColumn("lead", F.row_number().over(item.orderBy(F.desc("low"), "key")) == 1)
    led = led.withColumn("most", F.max("low").over(item)).where((F.col("alone") == 0) | (F.col("high") >= F.col("most")))
    ranked = led.withColumn("n", F.row_number().over(own.orderBy(F.desc("lead"), F.desc("low"), "key")))
    certain = ranked.withColumn("floor", F.max(F.when(F.col("lead") & (F.col("n") == keep), F.col("low"))).over(own))
    alive = certain.where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    left = scratch.table(
        alive.withColumn("n", F.row_number().over(own.orderBy(F.desc("high"), "key"))).select("query", "key", "high", "n"),
        "candidates",
    )

    scored, start, stop = None, 0, first_read
    while True:
        batch = left.where((F.col("n") > start) & (F.col("n") <= stop))
        exact = batch.join(queries.select("query", F.col("v").alias("q")), "query").join(distinct, "key")
        exact = exact.select("query", F.explode("ids").alias("vec_id"), _dot(F.col("q"), F.col("v")).alias("score"))
        exact = exact if scored is None else scored.unionByName(exact)
        best = exact.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))
        scored = scratch.table(best.withColumn("place", place).where(F.col("place") <= keep).drop("place"), "scored")
        kth = scored.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("have"))
        rest = left.where(F.col("n") > stop).join(kth, "query", "left")
        rest = rest.where(F.col("have").isNull() | (F.col("have") < keep) | (F.col("high") >= F.col("kth")))
        if rest.isEmpty():
            break
        left = scratch.table(rest.select("query", "key", "high", "n"), "candidates")
        start, stop = stop, stop * 4

    pairs = asking.join(queries, "v").select(F.col("vec_id").alias("query_id"), "query").join(scored, "query")
    pairs = pairs.where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
