"""Importance resampling towards a target distribution, with exact ranks by parallel sorting by regular sampling."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, per_text, prepare

BUCKETS = 10_000
LONGEST = 3  # words of a feature
MIN_WORDS = 20
PERCENT = 5
SEED = 42
SEGMENTS = 128  # of the sorted order
SAMPLES = 256  # regular samples of a run, and of a group of runs
GROUPS = 16  # runs whose samples are merged before the driver sees them
WORD_CACHE = 300_000

_POLYNOMIAL = 0xEDB88320
_SPACE = zlib.crc32(b" ")
# Bytes of words after lower-casing A-Z; every other byte separates.  All bytes of other scripts are from 0x80 on.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _shift_tables() -> np.ndarray:
    """table[k, i, b]: what byte i of a CRC-32, worth b, becomes when 2 ** k zero bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(_POLYNOMIAL), byte >> 1)

    def next_byte(crc: np.ndarray) -> np.ndarray:
        return (crc >> 8) ^ byte[crc & 255]

    one = np.stack([next_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
    tables = [one]
    for _ in range(30):
        last = tables[-1]
        tables.append(_apply(last, last))
    return np.stack(tables)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SHIFT = _shift_tables()
_SHORT = 64  # lengths whose shift is one lookup


def _short_tables() -> np.ndarray:
    tables = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
    for _ in range(_SHORT):
        tables.append(_apply(_SHIFT[0], tables[-1]))
    return np.stack(tables).ravel()


_BY_LENGTH = _short_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, from those of their halves (as 64-bit numbers) and the byte lengths of the right ones."""
    short = np.minimum(length, _SHORT)
    at = short << 10
    crc = _BY_LENGTH.take(at + (left & 255))
    crc ^= _BY_LENGTH.take(at + 256 + (left >> 8 & 255))
    crc ^= _BY_LENGTH.take(at + 512 + (left >> 16 & 255))
    crc ^= _BY_LENGTH.take(at + 768 + (left >> 24))
    rest = length - short
    if rest.any():
        for k in range(31):
            far = np.flatnonzero(rest >> k & 1)
            if len(far):
                crc[far] = _apply(_SHIFT[k], crc[far])
    return crc ^ right


class Features:
    """Buckets of all runs of one to LONGEST words of texts: CRC-32 of the run's words joined by spaces, modulo BUCKETS.

    A distinct word is hashed once; the hashes of runs come from those of their words, in arrays.
    """

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the buckets of all features."""
        words = text.encode().translate(_LOWER).split() if text else []
        if not words:
            return 0, np.zeros(0, np.int64)
        # A word's CRC-32 alone (upper half) and behind a space.
        known, long = self.known, {}
        for word in [w for w in set(words) if w not in known]:
            (known if len(word) <= 64 else long)[word] = zlib.crc32(word) << 32 | zlib.crc32(word, _SPACE)
        if long:
            hashed = np.fromiter((long[w] if w in long else known[w] for w in words), np.uint64, len(words))
        else:
            hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        run = (hashed >> np.uint64(32)).astype(np.int64)
        behind = (hashed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        runs = [run]
        for size in range(1, min(LONGEST, len(words))):
            run = joined_crc(run[:-1], behind[size:], length[size:])
            runs.append(run)
        if len(known) > WORD_CACHE:
            known.clear()
        return len(words), np.concatenate(runs) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features all rows of texts(text) have in each bucket; a task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = [features(text)[1] for text in batch.column(0).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    # At most BUCKETS rows reach the driver.
    summed = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p_target / p_source)) of each bucket, with one more count in each."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


_WEIGHED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])


def weigher(gain: np.ndarray) -> Callable[[Column], Column]:
    """A column function from text to its number of words, number of features and summed gain."""

    def make() -> Callable[[list[str | None]], pa.Array]:
        features = Features()

        def apply(texts: list[str | None]) -> pa.Array:
            found = [(n, len(buckets), int(gain[buckets].sum())) for n, buckets in map(features, texts)]
            columns = list(zip(*found)) if found else [[], [], []]
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_WEIGHED.names)

        return apply

    return per_text(make, _WEIGHED)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of a document, from the first 32 bits of SHA-256 of `seed:doc_id`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# --- parallel sorting by regular sampling -------------------------------------------------------------------------------

_KEY = "high long, low long"  # ascending: the negated score, then the id


def _sorted_keys(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """All (high, low) of a run, sorted: two longs a row."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    keys = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))]


def _regular(keys: np.ndarray, worth: np.ndarray, samples: int) -> pa.RecordBatch:
    """The ends of `samples` stretches of about equal worth, each with what it is worth."""
    upto = np.cumsum(worth)
    total = int(upto[-1]) if len(upto) else 0
    marks = np.unique(np.searchsorted(upto, np.arange(1, samples + 1) * (total / samples), side="left").clip(max=len(keys) - 1))
    marks = marks if total else marks[:0]
    ends = upto[marks] if total else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[marks, 0]), pa.array(keys[marks, 1]), pa.array(np.diff(ends, prepend=0).astype(np.int64))], names=["high", "low", "worth"]
    )


def splitters(keys: DataFrame, segments: int, samples: int = SAMPLES, groups: int = GROUPS) -> np.ndarray:
    """segments - 1 keys that cut keys(high, low) into segments of about equal size.

    Every task sorts its run and gives regular samples of it.  Groups of runs merge their samples and give regular
    samples again, so that the driver gets at most groups * samples keys, however many runs there are.
    """

    def of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _sorted_keys(batches)
        yield _regular(run, np.ones(len(run), np.int64), samples)

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches if b.num_rows]
        rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        yield _regular(rows[:, :2], rows[:, 2], samples)

    schema = f"{_KEY}, worth long"
    sampled = keys.mapInArrow(of_run, schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    merged = sampled.repartition(groups, "group").drop("group").mapInArrow(of_group, schema).toArrow()
    rows = np.stack([merged.column(n).to_numpy() for n in ("high", "low", "worth")], 1)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    upto = np.cumsum(rows[:, 2])
    marks = np.searchsorted(upto, np.arange(1, segments) * (upto[-1] / segments), side="left")
    return rows[marks, :2]


def _less(cuts: np.ndarray, keys: np.ndarray, or_equal: bool) -> np.ndarray:
    """How many of the cuts are below each of the keys, or equal to it if `or_equal`."""
    behind = np.repeat(np.array([not or_equal, or_equal]), [len(cuts), len(keys)])  # of those that are equal
    both = np.concatenate([cuts, keys])
    order = np.lexsort((behind, both[:, 1], both[:, 0]))
    is_cut = order < len(cuts)
    out = np.empty(len(keys), np.int64)
    out[order[~is_cut] - len(cuts)] = np.cumsum(is_cut)[~is_cut]
    return out


def segments_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The segment of each key: segment i lies up to and including cut i.

    Keys equal to several cuts may be in any segment that these bound; they are dealt to all of them in turn.
    """
    if not len(cuts):
        return np.zeros(len(keys), np.int64)
    first, last = _less(cuts, keys, or_equal=False), _less(cuts, keys, or_equal=True)
    # A key equal to cuts first..last-1 may be in any segment from first to last - 1.
    choices = np.maximum(last - first, 1)
    return first + np.arange(len(keys)) % choices


def _with_segments(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Rows with their segment.  Only the two key columns go to Python; numbers of a batch deal out equal keys."""

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for high, low in pairs:
            yield pa.array(segments_of(np.stack([high.to_numpy(), low.to_numpy()], 1), cuts).astype(np.int32))

    run.__annotations__ = {"pairs": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    segment = F.arrow_udf(run, T.IntegerType()).asNondeterministic()
    return rows.withColumn("segment", segment("high", "low"))


def ranked(rows: DataFrame, scratch: Scratch, take: Callable[[int], int] = int, segments: int = SEGMENTS) -> DataFrame:
    """rows(high, low, ...) with `rank` from 1 in the order of (high, low); null beyond the first take(number of rows).

    Regular samples of the sorted runs give the splitters; counts by segment, summed from the first, tell where the
    ranks of each segment start, and which segments lie wholly beyond the last rank: their rows do not travel.  The
    others are exchanged and sorted segment by segment.  Equal rows may change places, and those equal to several
    splitters are dealt to all segments that these bound, so that no key is too large for a task.
    """
    cuts = splitters(rows.select("high", "low"), segments)
    placed = scratch.table(_with_segments(rows, cuts), "segments")
    counts = [0] * segments
    for segment, n in placed.groupBy("segment").count().collect():  # at most `segments` rows
        counts[segment] = n
    starts = [0, *accumulate(counts)]
    last = take(starts.pop())
    reached = bisect_left(starts, last)
    start = F.element_at(F.lit(starts), F.col("segment") + 1)
    place = F.row_number().over(Window.partitionBy("segment").orderBy("high", "low"))
    within = placed.where(F.col("segment") < reached).withColumn("rank", (start + place).cast("long"))
    within = within.withColumn("rank", F.when(F.col("rank") <= last, F.col("rank")))
    beyond = placed.where(F.col("segment") >= reached).withColumn("rank", F.lit(None).cast("long"))
    return within.unionByName(beyond).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long): one row per input row.

    A document's features are the runs of one to three words of its whole text, hashed to BUCKETS buckets; a bucket's
    gain compares its share in all `target` texts with that in all documents, `weight` is the sum over the features
    and `score` adds noise that depends on seed and doc_id alone.  Of the N documents with at least `min_words` words
    the floor(percent * N / 100) with the highest scores, ties to the smaller doc_id, are drawn and ranked from 1;
    for all others `rank` is null.

    Null text has no words; a null doc_id counts as empty in the noise and comes first among equal scores; repeated
    rows count and are drawn one by one; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weigh = weigher(gains(bucket_counts(texts), bucket_counts(target)))
    weighed = texts.select("doc_id", weigh(F.col("text")).alias("w")).select("doc_id", "w.*")
    scored = scratch.table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    low = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    rows = scored.where(F.col("n_words") >= min_words).withColumn("high", -F.col("score")).withColumn("low", low)
    drawn = ranked(rows, scratch, lambda n: n * percent // 100)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rest.select(*columns))
