"""Quality rules: plain text measures, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, per_text, prepare, struct_array, with_ids

BUCKETS_LOG2 = 18
PRIOR = 20.0
THRESHOLD = -0.12
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def buckets(words: list[bytes]) -> np.ndarray:
    """Bucket numbers of all words and word pairs of a text."""
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    both = np.concatenate((one * np.uint64(0xFF51AFD7ED558CCD), (two ^ (two >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)))
    return (both >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of `window` words that the text holds at least twice, the first included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    total = covered = 0
    for at, gram in enumerate(grams):
        if times[gram] > 1:
            total += at + window - max(at, covered)
            covered = at + window
    return total


def measures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass
class Ratio:
    """log(p_trusted / p_raw) of each bucket; 0 where nothing is known."""

    log: np.ndarray

    def __call__(self, words: list[bytes]) -> float:
        """The summed ratio of a text's words and pairs, divided by their number; 0 for no words."""
        return float(self.log[buckets(words)].mean()) if words else 0.0


def ratio(trusted: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> Ratio:
    """Both multinomials share a prior of `prior` counts a bucket in proportion to the raw one, so rare grams say little."""
    if not trusted.sum() or not raw.sum():
        return Ratio(np.zeros(len(raw)))
    expected = raw * (trusted.sum() / raw.sum())
    return Ratio(np.log((trusted + prior) / (expected + prior)))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of texts(text); every task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS_LOG2, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, buckets(ascii_words(text)), 1)
        held = np.flatnonzero(total)
        for at in range(0, len(held), 50_000):
            part = held[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def learn_ratio(docs: DataFrame, labels: DataFrame) -> Ratio:
    """The ratio over all documents, with those labelled quality 1 as the trusted ones.

    Only the bucket counts, 2 ** BUCKETS_LOG2 at most, reach the driver.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    counted = []
    for part in (with_ids(texts, good, "doc_id"), texts):
        rows = bucket_counts(part).toArrow()
        total = np.zeros(1 << BUCKETS_LOG2)
        total[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        counted.append(total)
    return ratio(*counted)


_RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def judge(learned: Ratio, threshold: float = THRESHOLD) -> Callable[[Column], Column]:
    """A column function from text to the measures, base_failed, llr (a gram) and kept."""

    def make() -> Callable[[list[str | None]], pa.Array]:
        def apply(texts: list[str | None]) -> pa.Array:
            rows = []
            for text in texts:
                words = ascii_words(text)
                found = measures(text or "", words)
                failed = base_failed(found[0], found[4])
                value = learned(words)
                rows.append((*found, failed, value, not failed and value >= threshold))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = list(map(list, zip(*rows))) if rows else [[] for _ in types]
            return struct_array(_RESULT.names, types, columns)

        return apply

    return per_text(make, _RESULT)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, llr, kept: one row per input row, over the whole text.

    A document is kept unless a base rule fails it or its length-normalised ratio is under `threshold`.  Null text has
    no words, so a base rule fails it.  Repeated rows come back as often as they are there (and count as often in the
    corpus); without trusted rows every ratio is 0; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    verdict = judge(learn_ratio(docs, labels), threshold)
    return docs.select("doc_id", verdict(F.col("text")).alias("r")).select("doc_id", "r.*")
