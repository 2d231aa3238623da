"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fold_of, per_text, prepare, struct_array

BUCKETS_LOG2 = 17
DIMENSIONS = 16
SAMPLE_ROWS = 2000
SAMPLE_COUNTS = 16_000_000  # bucket counts of all sampled rows together
STEPS = 10_000
RATE = 0.5
_BLANK = 1
_MAX_POWER = 1 << 12


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_C = _odd(7, 8)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_MAX_POWER, 0x9E3779B97F4A7C15 | 1, np.uint64))


def features(text: str | None, bits: int = BUCKETS_LOG2) -> np.ndarray:
    """Bucket numbers, with repetition, of a whole text's words, word pairs and in-word character 3- and 4-grams.

    Words are runs without ASCII or Unicode space; characters are code points, with a blank at both ends of a word.
    A pair of equal words also counts in bucket 1, whichever word it is.  Bucket 0 stands for the document itself, so
    an empty text has a vector too.
    """
    own = np.zeros(1, np.int64)
    if not text:
        return own
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (points <= 32) | (points == 0x85) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x200A)) | (points == 0x3000)
    if space.all():
        return own
    x = np.full(len(points) + 2, _BLANK, np.uint64)
    x[1:-1] = np.where(space, _BLANK, points)
    x = x[np.concatenate(([True], (x[1:] != _BLANK) | (x[:-1] != _BLANK)))]
    blank = x == _BLANK
    ends = np.flatnonzero(blank)
    starts, sizes = ends[:-1] + 1, np.diff(ends) - 1
    inside = np.arange(len(x)) - np.repeat(ends, np.diff(np.append(ends, len(x))))
    shift = np.uint64(64 - bits)
    words = np.add.reduceat(x * _POWERS[inside % _MAX_POWER], starts) if len(starts) else np.zeros(0, np.uint64)
    words = words - x[starts + sizes]  # reduceat ran up to the next start and so took in the blank's own term
    three = x[:-2] * _C[0] + x[1:-1] * _C[1] + x[2:] * _C[2]
    four = three[:-1] * _C[3] + x[3:] * _C[4] if len(three) else three
    parts = [
        (words ^ (words >> np.uint64(29))) * _C[5],
        (words[:-1] * _C[6] + words[1:]) * _C[7],
        three[~blank[1:-1]] * _C[5],
        four[~(blank[1:-2] | blank[2:-1])] * _C[6] if len(four) else four,
    ]
    hashed = np.concatenate([(p ^ (p >> np.uint64(31))) * _C[4] >> shift for p in parts])
    same = np.ones(int((words[1:] == words[:-1]).sum()), np.int64)
    return np.concatenate((own, same, np.maximum(hashed, 2).astype(np.int64)))


@dataclass
class Model:
    """Bucket vectors and output weights of two classes; `logit[b]` is what one count of bucket b adds."""

    vectors: np.ndarray
    weights: np.ndarray

    @property
    def logit(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BUCKETS_LOG2, seed: int = 1) -> Model:
    """Stochastic gradient descent over documents given as (buckets, counts).

    At least STEPS steps in whole passes, one document each; the rate falls linearly to 0.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (1 << bits, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, 2), np.float32)
    passes = -(-STEPS // len(docs))
    steps, step = passes * len(docs), 0
    for _ in range(passes):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1.0 - step / steps)
            step += 1
            buckets, counts = docs[i]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[buckets]
            z = hidden @ weights
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            vectors[buckets] -= rate * np.outer(share, back) * len(buckets) ** 0.5
    return Model(vectors, weights)


def learn(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_counts: int = SAMPLE_COUNTS, parts: int = 3, held: int = 1
) -> Model:
    """A model from at most `sample_rows` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    The chosen labels are bounded by `sample_rows` and so may be broadcast; a (doc_id, label) that comes several times
    counts once.  Of the texts that one doc_id has, the one with the smallest hash is learned from.  A sampled document
    reaches the driver as bucket counts; those that would bring them over `sample_counts` together, 8 bytes each, are
    left out in the order of the hash.  So the sample does not depend on how rows are laid out.  Without rows of both
    classes the model says 0.5 throughout.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id"), parts) != held))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .distinct()
        .orderBy(order, "doc_id", "quality")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.unique(features(t), return_counts=True) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(s[0]) for s in seen], pa.int32()),
                    pa.array([s[0].astype(np.int32) for s in seen], pa.list_(pa.int32())),
                    pa.array([s[1].astype(np.int32) for s in seen], pa.list_(pa.int32())),
                ],
                names=["place", "doc_id", "quality", "size", "buckets", "counts"],
            )

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality")
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]  # a null text, with the seed's hash, too
    rows = texts.agg(text.alias("text")).select(order.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    counted = rows.mapInArrow(run, "place long, doc_id long, quality int, size int, buckets array<int>, counts array<int>")
    counted = Scratch(docs.sparkSession).table(counted, "sample")
    taken, room = [], sample_counts
    sizes = sorted(counted.select("place", "doc_id", "quality", "size").collect())  # at most sample_rows
    for r in sizes:
        if r.size <= room:
            room -= r.size
            taken.append(r)
    y = np.array([r.quality for r in sorted(taken, key=lambda r: (r.doc_id, r.quality))], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((1 << BUCKETS_LOG2, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, 2), np.float32))
    if len(taken) < len(sizes):
        ids = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in taken], "doc_id long, quality int")
        counted = counted.join(F.broadcast(ids), ["doc_id", "quality"], "left_semi")
    table = counted.select("doc_id", "quality", "buckets", "counts").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    return train([(np.array(b.values), np.array(c.values)) for b, c in zip(table.column("buckets"), table.column("counts"))], y)


_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(model: Model) -> Callable[[Column], Column]:
    """A column function from text to struct(score, predicted): the softmax share of class 1 over the whole text."""
    logit = model.logit

    def make() -> Callable[[list[str | None]], pa.Array]:
        def apply(texts: list[str | None]) -> pa.Array:
            scores = []
            for text in texts:
                z = float(logit[features(text)].mean(dtype=np.float64))
                scores.append(1.0 / (1.0 + np.exp(-z)))
            return struct_array(_RESULT.names, [pa.float64(), pa.int32()], [scores, [int(s >= 0.5) for s in scores]])

        return apply

    return per_text(make, _RESULT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, from the whole text alone.

    Null text counts as empty and gets the score of a document without words.  A null doc_id is not held out and not
    learned from.  A label that comes twice counts once; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rate = score(learn(docs, labels))
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), rate(F.col("text")).alias("r")).select("doc_id", "held_out", "r.*")
