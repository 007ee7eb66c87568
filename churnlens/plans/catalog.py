"""Registered queries: one per operator of the survey inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables mapped by
``churnlens.sources``. ``ORACLE`` holds the DuckDB SQL for the exact ones. Results are
normalised (doubles rounded to 6 digits, small integers widened to BIGINT) so the
oracle comparison is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _norm_sql(expr: str, dt, digits: int, depth: int = 0) -> str | None:
    """SQL text of the normalised value, or None when the column stays as it is."""
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0D"   # -0.0 -> 0.0
    if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
        return f"CAST({expr} AS BIGINT)"
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType, T.ArrayType)):
        v = f"__x{depth}"
        inner = _norm_sql(v, dt.elementType, digits, depth + 1)
        return None if inner is None else f"transform({expr}, {v} -> {inner})"
    return None


def normalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """One ``selectExpr`` (a single plan analysis) over all columns."""
    exprs = []
    for f in df.schema.fields:
        e = _norm_sql(_q(f.name), f.dataType, digits)
        exprs.append(_q(f.name) if e is None else f"{e} AS {_q(f.name)}")
    return df.selectExpr(*exprs)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    import importlib
    import pkgutil

    import churnlens.plans as plans
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"churnlens.plans.{m.name}")
