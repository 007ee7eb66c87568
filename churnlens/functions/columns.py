"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(n: str | Column, d: str | Column, default: float | None = 0.0) -> Column:
    """``n / d`` with zero, null or non-finite results replaced by ``default``."""
    q = F.try_divide(col(n).cast("double"), col(d).cast("double"))
    q = F.when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit(None)).otherwise(q)
    return q if default is None else F.coalesce(q, F.lit(default))


def finite_or(c: str | Column, default: float = 0.0) -> Column:
    x = col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def clip(c: str | Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    x = col(c)
    if lo is not None:
        x = F.greatest(x, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        x = F.least(x, hi if isinstance(hi, Column) else F.lit(hi))
    return x


def risk_level_right_closed(p: str | Column) -> Column:
    """(-0.001, .25] low, (.25, .5] medium, (.5, .75] high, else critical."""
    x = col(p)
    return (F.when(x <= 0.25, "low").when(x <= 0.5, "medium").when(x <= 0.75, "high")
            .otherwise("critical"))


def risk_level_left_closed(p: str | Column) -> Column:
    """>= .75 critical, >= .5 high, >= .25 medium, else low (R2)."""
    x = col(p)
    return (F.when(x >= 0.75, "critical").when(x >= 0.5, "high").when(x >= 0.25, "medium")
            .otherwise("low"))


def unpivot(df: DataFrame, ids: list[str], cols: list[str], var: str = "feature",
            val: str = "value", cast: str = "double") -> DataFrame:
    """Long form ``(ids..., var, val)`` with one row per id and column (``stack``)."""
    casted = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols])
    return casted.unpivot(ids, cols, var, val)


#: Rows that a ``small_table`` may have.
SMALL_ROWS = 100_000


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Materialise a result whose size is bounded by parameters (features x bins, stages)
    as a literal table, so that later joins do not re-run the plan that produced it; a larger one is
    an error."""
    rows = df.collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: the table is not bounded by parameters")
    return df.sparkSession.createDataFrame(rows, df.schema)
