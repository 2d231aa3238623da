"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, per_text, prepare, struct_array

PROFILE = 400
DOC_GRAMS = 400
MAX_LANGUAGES = 5000
FLUSH = 400_000
UNKNOWN = "und"
_BLANK = 1


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ranked_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a whole text and their counts, most frequent first, ties by gram.

    Letters are lower-cased; every run without letters is one blank.  A gram is its code points, 21 bits each, with
    the blank as 1; grams do not reach over a blank.
    """
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return none, none
    x = np.full(len(points) + 2, _BLANK, np.int64)
    x[1:-1] = np.where(letter, points, _BLANK)
    x = x[np.concatenate(([True], (x[1:] != _BLANK) | (x[:-1] != _BLANK)))]
    blank = x == _BLANK
    grams = np.concatenate(
        (x[~blank], x[:-1] | x[1:] << 21, (x[:-2] | x[1:-1] << 21 | x[2:] << 42)[~blank[1:-1]])
    )
    keys, counts = np.unique(grams, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    return keys[order], counts[order]


class _Tally:
    """Counts of (language, gram), merged as they come; holds at most about FLUSH grams a language between merges."""

    def __init__(self) -> None:
        self.waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size: dict[str, int] = {}

    def add(self, lang: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        self.waiting.setdefault(lang, []).append((keys, counts))
        self.size[lang] = self.size.get(lang, 0) + len(keys)
        if self.size[lang] > FLUSH:
            keys, counts = self._merged(lang)
            if len(keys) > FLUSH // 2:
                yield lang, keys, counts
                del self.waiting[lang], self.size[lang]
            else:
                self.waiting[lang], self.size[lang] = [(keys, counts)], len(keys)

    def _merged(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.waiting[lang]])
        counts = np.concatenate([c for _, c in self.waiting[lang]])
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, counts)
        return keys, total

    def rest(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang in self.waiting:
            yield lang, *self._merged(lang)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of texts(lang, text); counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def rows(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = ranked_grams(text)
                if len(keys):
                    for out in tally.add(lang, keys, counts):
                        yield rows(*out)
        for out in tally.rest():
            yield rows(*out)

    partial = texts.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Profiles:
    """Languages in name order; `place[l, g]` is the rank of `grams[g]` in language l, -1 where it is not ranked."""

    languages: list[str]
    grams: np.ndarray
    place: np.ndarray
    size: int


def learn_profiles(texts: DataFrame, size: int = PROFILE) -> Profiles:
    """The `size` most frequent grams of each language over all rows of texts(lang, text); ties by gram.

    Only these ranks reach the driver: languages times `size` rows.  More than MAX_LANGUAGES languages are an error.
    """
    counts = gram_counts(texts.where(F.col("lang").isNotNull()))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("lang", "gram", "place")
    rows = top.limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted({r.lang for r in rows})
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    place = np.full((len(languages), len(grams)), -1, np.int32)
    number = {lang: i for i, lang in enumerate(languages)}
    if rows:
        at = np.searchsorted(grams, [r.gram for r in rows])
        place[[number[r.lang] for r in rows], at] = [r.place - 1 for r in rows]
    return Profiles(languages, grams, place, size)


def out_of_place(profiles: Profiles, keys: np.ndarray) -> np.ndarray:
    """For each language, the summed rank differences of a text's ranked grams; an unranked gram costs `size`."""
    at = np.minimum(np.searchsorted(profiles.grams, keys), len(profiles.grams) - 1)
    place = profiles.place[:, at]
    cost = np.minimum(np.abs(place - np.arange(len(keys), dtype=np.int32)), profiles.size)
    cost[(place < 0) | (profiles.grams[at] != keys)] = profiles.size
    return cost.sum(axis=1)


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(profiles: Profiles, doc_grams: int = DOC_GRAMS) -> Callable[[Column], Column]:
    """A column function from text to struct(lang_pred, score): the language at the smallest distance, ties by name.

    The score is 1 - distance / largest possible distance.  `und` with score 0 where the text is null or has no
    letter, or where no language was learned.
    """

    def make() -> Callable[[list[str | None]], pa.Array]:
        def apply(texts: list[str | None]) -> pa.Array:
            langs, scores = [], []
            for text in texts:
                keys = ranked_grams(text)[0][:doc_grams]
                if not len(keys) or not profiles.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                distance = out_of_place(profiles, keys)
                best = int(np.argmin(distance))
                langs.append(profiles.languages[best])
                scores.append(1.0 - float(distance[best]) / (profiles.size * len(keys)))
            return struct_array(_RESULT.names, [pa.string(), pa.float64()], [langs, scores])

        return apply

    return per_text(make, _RESULT)


def training_rows(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """The rows to learn from: lang known, and crc32(doc_id as text) mod `parts` is not `held` (nor null)."""
    return docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), parts) != held)).select("lang", "text")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row, from the whole text alone.

    Profiles come from all training rows.  Null text, or text without a letter: `und`, 0.  A null doc_id is neither
    held out nor learned from.  Repeated rows count and come back as often as they are there; other columns are not
    read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    guess = predict(learn_profiles(training_rows(docs)))
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), guess(F.col("text")).alias("r")).select("doc_id", "held_out", "r.*")
