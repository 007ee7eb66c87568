"""Exact linear-interpolated quantiles that scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer, so a global percentile over a huge column ends in one task. Here values are
first aggregated by distinct value (a hot value collapses into one row), then ranked by
``global_order``, which also gives each row its group's size; only the rows that bracket the
wanted positions are aggregated, without a join. Same definition as pandas / numpy
``linear`` and DuckDB ``quantile_cont``: position ``h = (n - 1) * p``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.prefix import global_order
from churnlens.session import cut_lineage


def value_counts(df: DataFrame, value_col: str, group_cols: list[str] | tuple = ()) -> DataFrame:
    """``(group..., __v, __c)``: non-null, non-NaN distinct values and their counts,
    checkpointed because the count, the ranking and the group sizes all read it."""
    v = F.col(value_col).cast("double")
    vals = (df.select(*group_cols, v.alias("__v"))
            .filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
            .groupBy(*group_cols, "__v").agg(F.count(F.lit(1)).alias("__c")))
    return cut_lineage(vals)


def grouped_quantiles(df: DataFrame, value_col: str, probs: list[float],
                      group_cols: list[str] | tuple = (), out_col: str = "q") -> DataFrame:
    """``(group..., q_index, prob, q)`` for every group and probability."""
    return quantiles_from_counts(value_counts(df, value_col, group_cols), probs, group_cols, out_col)


def quantiles_from_counts(vals: DataFrame, probs: list[float], group_cols: list[str] | tuple = (),
                          out_col: str = "q") -> DataFrame:
    """Quantiles from a :func:`value_counts` table."""
    groups = list(group_cols)
    ranked = global_order(vals, [("__v", True)], partition_by=groups, sums={"__cum": "__c"}, totals={"__n": "__cum"},
                          rank_col=None)
    # 0-based places lo and hi of each probability; a value covers the places from cum - c to cum - 1.
    wanted = F.array(*[F.struct(F.lit(i).alias("q_index"), F.lit(float(p)).alias("prob"), (F.col("__n") - 1).alias("last"))
                       for i, p in enumerate(probs)])
    start = F.col("__cum") - F.col("__c")
    covers = lambda place: (start <= place) & (place < F.col("__cum"))
    place = lambda x: x["last"] * x["prob"]
    hits = F.filter(wanted, lambda x: covers(F.floor(place(x))) | covers(F.ceil(place(x))))
    picked = ranked.select(*groups, "__v", "__cum", "__c", F.explode(hits).alias("x"))
    h = place(F.col("x"))
    res = picked.groupBy(*groups, F.col("x.q_index").alias("q_index"), F.col("x.prob").alias("prob")).agg(
        F.max(F.when(covers(F.floor(h)), F.col("__v"))).alias("__lo"),
        F.max(F.when(covers(F.ceil(h)), F.col("__v"))).alias("__hi"), F.max(h - F.floor(h)).alias("__frac"))
    return res.select(*groups, "q_index", "prob",
                      (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias(out_col))


def quantiles(df: DataFrame, value_col: str, probs: list[float]) -> list[float | None]:
    """Global quantiles as Python floats (``len(probs)`` values reach the driver)."""
    rows = grouped_quantiles(df, value_col, probs).collect()
    got = {r["q_index"]: r["q"] for r in rows}
    return [got.get(i) for i in range(len(probs))]


def quantile(df: DataFrame, value_col: str, prob: float) -> float | None:
    return quantiles(df, value_col, [prob])[0]
