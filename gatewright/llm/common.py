"""Helpers shared by the operators: session set-up, shared tables, word and segment splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_DEFAULT = "10000"
TEXT_BATCH = "256"

SPECIAL = "<|endoftext|>"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays small.  A value set by the user is kept."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, TEXT_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables of one run in the shared folder.  A written table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self._made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def per_text(make: Callable[[], Callable[[list[str | None]], pa.Array]], result: T.DataType) -> Callable[[Column], Column]:
    """A column function from text to `result`: `make` builds the state of a task, its result maps a batch of texts.

    Only the text column travels to Python, so other columns, whatever their names, stay untouched in the JVM.
    The function counts as non-deterministic, so that a filter on its result never runs it a second time.
    """

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for batch in texts:
            yield apply(batch.to_pylist())

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, result).asNondeterministic()


def struct_array(names: list[str], types: list[pa.DataType], columns: list[list]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


ID_SLOTS = 1 << 19


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose `key` (a long) is among `ids`, at every size by the same plan.

    A fixed number of hash slots, which may be broadcast because of that, first drops most other rows; those left are
    shuffled for an exact semi-join, so that wide rows without a partner do not travel.
    """

    def slot(d: DataFrame) -> Column:
        return F.pmod(F.xxhash64(d[key]), F.lit(ID_SLOTS)).cast("int")

    slots = ids.select(slot(ids).alias("__slot")).distinct()
    near = df.withColumn("__slot", slot(df)).join(F.broadcast(slots), "__slot", "left_semi").drop("__slot")
    return near.join(ids.select(key).distinct().hint("merge"), key, "left_semi")


def fold_of(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode().split() if text else []


_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def lone_space_parts(text: str) -> list[str]:
    """Split at spaces that stand alone between two non-space characters (and at one at either end).

    The byte-level pre-tokenizer always starts a new piece at such a space, so each part can be encoded by itself,
    with the space put back in front of every part but the first.
    """
    for c in _SPACES:
        if c in text and (c + " " in text or " " + c in text):
            return _LONE_SPACE.split(text)
    return text.split(" ")


class TwoGenerations(dict):
    """A bounded cache: once it holds `limit` entries they become the older half, and those still in use move back.

    It only saves repeated work.  After `missing(keys)` the dict holds every key but those returned.
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit
        self.older: dict = {}

    def missing(self, keys: set) -> list:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        absent = [key for key in keys if key not in self]
        if not self.older:
            return absent
        older, lost = self.older, []
        for key in absent:
            if key in older:
                self[key] = older[key]
            else:
                lost.append(key)
        return lost
