"""MinHash near-duplicates by an inverted join over signature coordinates, confirmed on full shingle sets.

Every text has a set of word shingles and a signature of `COORDINATES` minima.  Documents with equal sets are one node.
A node is posted under each (coordinate, value); two nodes linked at the similarity asked for agree on at least
`MATCHES` coordinates, but for a chance of about 1e-6.  Three exact rules keep the lists short:

* prefix: of a node's values that others share, taken rarest first, all but MATCHES - 1 are posted; a pair that
  agrees on MATCHES values meets in at least one list, and a node with fewer shared values meets nobody;
* skip: a node whose shingles are too often its own cannot reach the similarity with any other posted node;
* leaders: in each list every node is first compared with the list's smallest, its leader: the collisions over all
  coordinates are counted, and a pair with MATCHES or more is confirmed on its sets.  Pairs inside one component need
  no look any more.  Two nodes of different components that met in a list have its leader in common.  What each lacks
  of the shingles that most nodes of a leader hold, and has beyond them, gives their overlap exactly (`_second_links`):
  nodes near that middle link through the nearest of them, and others must share what sets them apart from it, so they
  meet under (leader, shingle) by a prefix rule.  Texts of one template share only the middle and so meet nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, per_text, prepare, with_ids

SHINGLE = 5
PERCENT = 85
COORDINATES = 48
MATCHES = 26
_CHUNK = 8192


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = _constants(11, SHINGLE)
_A = _constants(12, COORDINATES)[:, None]
_B = _constants(13, COORDINATES)[:, None]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it has fewer words."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        x = (h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
    else:
        last = len(h) - SHINGLE + 1
        x = sum(h[i : i + last] * _PLACE[i] for i in range(SHINGLE))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(x ^ (x >> np.uint64(31)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of COORDINATES hash functions over the set, as signed 32-bit numbers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, (shingles[at : at + _CHUNK] * _A + _B).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            made = np.concatenate([signature(s) for s in sets]) if sets else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES, pa.array(made)),
                ],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<int>")


_SET = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _make_sets():
    def apply(texts: list[str | None]) -> pa.Array:
        sets = [shingle_set(t) for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(ends, pa.array(values))
        return pa.StructArray.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), lists], names=_SET.names)

    return apply


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached, for all nodes of edges(a, b).

    In every round each label hooks onto the smallest label next to it and the edges move up to the labels; the
    number of rounds grows with the logarithm of a component's length.  Nothing but the emptiness test reaches the
    driver.
    """
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = ends.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        hooks = scratch.table(edges.groupBy(F.col("a").alias("was")).agg(F.min("b").alias("now")), "hooks")
        further = hooks.select(F.col("was").alias("now"), F.col("now").alias("next"))
        hooks = scratch.table(hooks.join(further, "now", "left").select("was", F.coalesce("next", "now").alias("now")), "hooks")
        labels = scratch.table(
            labels.join(hooks, labels.component == hooks.was, "left").select("node", F.coalesce("now", "component").alias("component")),
            "labels",
        )
        up = edges.join(hooks, edges.a == hooks.was, "left").select(F.coalesce("now", "a").alias("a"), "b")
        up = up.join(hooks, up.b == hooks.was, "left").select("a", F.coalesce("now", "b").alias("b"))
        edges = scratch.table(up.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels


def _reaches(overlap: Column, size_a: Column, size_b: Column) -> Column:
    """Whether a pair with `overlap` common shingles has the similarity asked for."""
    return (100 + PERCENT) * overlap >= PERCENT * (size_a + size_b)


def _posted(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """token, node: each node under the rarest of its shared coordinate values, as many as the prefix rule needs."""
    tokens = nodes.select("node", F.posexplode("signature").alias("at", "value")).select(
        "node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("token")
    )
    shared = scratch.table(tokens.groupBy("token").count().where("count > 1"), "shared-values")
    own = Window.partitionBy("node")
    met = tokens.join(shared, "token").select(
        "node",
        "token",
        F.count("*").over(own).alias("held"),
        F.row_number().over(own.orderBy("count", "token")).alias("place"),
    )
    return scratch.table(met.where(F.col("place") <= F.col("held") - MATCHES + 1).select("token", "node"), "posted")


def _with_sets(scratch: Scratch, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The posted nodes with their shingles, without those that no other posted node can be similar to.

    `common` counts a node's shingles that another posted node has too.
    """

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where(F.col("node").isNotNull())
    texts = with_ids(texts, nodes, "node")
    sets = texts.select("node", per_text(_make_sets, _SET)(F.col("text")).alias("s")).select("node", "s.*")
    full = scratch.table(nodes.join(sets, ["node", "digest"]), "sets")
    alone = full.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
    alone = alone.agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    alone = scratch.table(alone, "alone")
    common = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    return scratch.table(
        full.join(alone, "node", "left").withColumn("common", common).where(100 * F.col("common") >= PERCENT * F.col("n_shingles")).drop("alone"),
        "nodes",
    )


def _confirm(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that collide on MATCHES coordinates and have the similarity on their full sets."""

    def side(name: str) -> DataFrame:
        return nodes.select(
            F.col("node").alias(name), F.col("signature").alias(f"sig_{name}"), F.col("shingles").alias(f"set_{name}")
        )

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    collisions = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    similar = _reaches(overlap, F.size("set_a"), F.size("set_b"))
    return both.where(F.when(collisions >= MATCHES, similar).otherwise(False)).select("a", "b")


def _middles(scratch: Scratch, met: DataFrame, nodes: DataFrame) -> DataFrame:
    """leader, middle: the shingles that more than half of the nodes of met(a, b) with one leader hold.

    One row a leader; written out, like every side with one row a leader, so that a join can split a hot leader.
    """
    held = met.join(nodes.select(F.col("node").alias("b"), F.explode("shingles").alias("shingle")), "b")
    counts = held.groupBy(F.col("a").alias("leader"), "shingle").agg(F.count("*").alias("n"))
    members = scratch.table(met.groupBy(F.col("a").alias("leader")).agg(F.count("*").alias("members")), "members-of-leaders")
    most = counts.join(members, "leader").where(2 * F.col("n") > F.col("members")).select("leader", "shingle")
    middles = scratch.table(most, "middle-shingles").groupBy("leader").agg(F.collect_list("shingle").alias("middle"))
    every = members.join(middles, "leader", "left")
    return scratch.table(every.select("leader", F.coalesce("middle", F.array().cast("array<long>")).alias("middle")), "middles")


def _differences(scratch: Scratch, met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of met(a, b, component): what node b lacks of the middle of its leader a, and what it has beyond it.

    With `size` of the middle, a pair x, y of one leader is linked if (100 + PERCENT) * (differences that both share)
    is at least due_x + due_y - (100 + PERCENT) * size.
    """
    node = nodes.select(F.col("node").alias("b"), "n_shingles", "common", F.col("shingles").alias("own"))
    joined = met.select("b", F.col("a").alias("leader"), "component").join(node, "b").join(_middles(scratch, met, nodes), "leader")
    missing = F.size(F.array_except("middle", "own"))
    return joined.select(
        "leader", F.size("middle").alias("size"), F.col("b").alias("node"), "component", "n_shingles", "common",
        ((100 + PERCENT) * missing + PERCENT * F.col("n_shingles")).alias("due"),
        F.concat(F.array_except("middle", "own"), F.array_except("own", "middle")).alias("apart"),
    )


def _second_links(scratch: Scratch, members: DataFrame) -> DataFrame:
    """a, b: links between the nodes of a leader that connect all whom links between them connect.

    * Two nodes with due_x + due_y <= (100 + PERCENT) * size are linked whatever they share.  Then each of them is
      linked with the node of the smallest due, so links with that one stand for all of these pairs.
    * Any other link shares at least one difference, and as many as the smallest due asks for: of a node's differences
      that others of the leader have too, rarest first, all but that many less one are posted under (leader, shingle).
    """
    whole = 100 + PERCENT
    nearest = members.groupBy("leader").agg(F.min(F.struct("due", "node")).alias("least"))
    nearest = scratch.table(nearest.select("leader", F.col("least.due").alias("least_due"), F.col("least.node").alias("least_node")), "nearest")
    known = scratch.table(members.join(nearest, "leader"), "members")
    star = known.where((F.col("due") + F.col("least_due") <= whole * F.col("size")) & (F.col("node") != F.col("least_node")))
    star = star.select(F.col("node").alias("a"), F.col("least_node").alias("b"))

    needed = F.greatest(F.lit(1), F.ceil((F.col("due") + F.col("least_due") - whole * F.col("size")) / whole))
    tokens = known.where(F.size("apart") >= needed).select("leader", "node", needed.alias("needed"), F.explode("apart").alias("shingle"))
    shared = scratch.table(tokens.groupBy("leader", "shingle").agg(F.count("*").alias("n")).where("n > 1"), "shared-differences")
    own = Window.partitionBy("leader", "node")
    placed = tokens.join(shared, ["leader", "shingle"]).select(
        "leader", "node", "shingle", "needed",
        F.count("*").over(own).alias("held"),
        F.row_number().over(own.orderBy("n", "shingle")).alias("place"),
    )
    facts = known.select("leader", "node", "component", "due", "size", "common", "n_shingles")
    posted = placed.where(F.col("place") <= F.col("held") - F.col("needed") + 1).select("leader", "shingle", "node")
    posted = scratch.table(posted.join(facts, ["leader", "node"]), "posted-differences")

    def side(name: str, *also: str) -> DataFrame:
        own = ("node", "component", "due", "common", "n_shingles")
        return posted.select("leader", "shingle", *also, *(F.col(c).alias(f"{c}_{name}") for c in own))

    met = side("a", "size").join(side("b"), ["leader", "shingle"]).where(
        (F.col("node_a") < F.col("node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & _reaches(F.least("common_a", "common_b"), F.col("n_shingles_a"), F.col("n_shingles_b"))
    )
    pairs = scratch.table(met.select("leader", "size", "node_a", "node_b", "due_a", "due_b").distinct(), "second-pairs")
    apart = known.select("leader", "node", "apart")
    both = pairs.join(apart.select("leader", F.col("node").alias("node_a"), F.col("apart").alias("apart_a")), ["leader", "node_a"])
    both = both.join(apart.select("leader", F.col("node").alias("node_b"), F.col("apart").alias("apart_b")), ["leader", "node_b"])
    enough = whole * F.size(F.array_intersect("apart_a", "apart_b")) >= F.col("due_a") + F.col("due_b") - whole * F.col("size")
    return star.unionByName(both.where(enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct()


def _links(scratch: Scratch, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component of all nodes that are linked with another."""
    posted = _posted(scratch, nodes)
    full = _with_sets(scratch, docs, nodes.join(posted.select("node").distinct(), "node", "left_semi"))
    lists = scratch.table(posted.join(full.select("node", "n_shingles", "common"), "node"), "lists")

    leaders = scratch.table(lists.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "leaders")
    pairs = lists.join(leaders.select("token", "a"), "token").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    pairs = scratch.table(pairs, "leader-pairs")
    first = scratch.table(_confirm(pairs, full), "leader-links")
    known = components(scratch, first)

    met = pairs.join(known.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    met = scratch.table(met, "pairs-by-component")
    sizes = met.groupBy("a", "component").agg(F.count("*").alias("n"))
    mixed = scratch.table(sizes.groupBy("a").agg(F.count("*").alias("parts")).where("parts > 1").select("a"), "mixed-leaders")
    members = scratch.table(_differences(scratch, scratch.table(met.join(mixed, "a"), "met-by-leader"), full), "differences")
    return components(scratch, first.unionByName(_second_links(scratch, members)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked if 100 * common shingles >= 85 * all shingles of both; a component is all that links
    reach and is named by its smallest doc_id, the one that is kept.  A text without words (or null) has no shingles
    and is linked with nothing.  Rows with equal sets, however many, are one node, so hot groups of copies stay small;
    repeated rows come back as often as they are there.  A row with null doc_id takes part in nothing: null
    component_id, kept.  Should one doc_id carry several texts and be the smallest id of more than one of them, those
    texts count as one node.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    signed = scratch.table(signatures(docs), "signatures")
    groups = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    nodes = scratch.table(groups, "groups")
    # Sets of up to five shingles reach the similarity only with their equals.
    linked = _links(scratch, docs, nodes.where("n_shingles > 5"))
    named = scratch.table(
        nodes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")),
        "named",
    )
    rows = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )
