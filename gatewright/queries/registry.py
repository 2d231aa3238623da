"""Registration and loading helpers for the query catalogue."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatewright.queries import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use any view name of `views.VIEWS`."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = views.oracle(sql)
        return fn

    return add


# Java runs methods of more than 8,000 bytes uncompiled; those of a wide view are several times as long.
_METHOD_CONF, _METHOD_DEFAULT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_METHOD_CONF, _METHOD_DEFAULT) == _METHOD_DEFAULT:  # a value set by the user is kept
        spark.conf.set(_METHOD_CONF, METHOD_BYTES)
    return spark.sql(views.spark_sql(name, lambda t: _source(spark, sf_dir, t)))


def view_on(spark: SparkSession, sf_dir: str, name: str, given: dict[str, str]) -> DataFrame:
    """A `view` on temporary views that stand for views or driver tables."""
    return spark.sql(views.spark_sql(name, lambda t: given.get(t) or _source(spark, sf_dir, t), set(given)))


def _source(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Name of a temporary view over a driver table, read as it is (split sizes are the session's)."""
    label = f"gw_{name}_{zlib.crc32(sf_dir.encode())}"
    if not spark.catalog.tableExists(label):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(label)
    return label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
