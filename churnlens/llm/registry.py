"""Queries of this subpackage and their DuckDB SQL; ``load()`` imports every operator module."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load() -> None:
    import churnlens.llm as pkg
    for m in pkgutil.iter_modules(pkg.__path__):
        importlib.import_module(f"{pkg.__name__}.{m.name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of the column over all rows (one scan, one number to the driver)."""
    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the files are installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Bound the rows of an Arrow batch in this session: whole texts may be long."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df
