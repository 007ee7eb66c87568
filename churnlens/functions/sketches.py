"""Mergeable quantile sketches: approximate bins and fences of any span of days without a second scan.

One KLL sketch a day and feature is built by a partial aggregate and kept (a few kilobytes whatever the number
of rows); sketches of days, or of stores, merge by aggregation. A quantile's rank is off by at most
``rank_error(k)`` of the rows with 99 % confidence. Exact quantiles (``functions/quantiles.py``) stay
the default of all operators; these are an option where a span is read again and again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch (8 to 65535).
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Two-sided normalised rank error of a KLL sketch at 99 % confidence (the published fit)."""
    return 2.446 / k ** 0.9433


def daily_sketches(df: DataFrame, features: list[str], day: str, k: int = SKETCH_K) -> DataFrame:
    """(day, feature, sketch, n, low, high): null and NaN values are left out."""
    long = df.select(F.to_date(day).alias("day"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x")).select("day", "x.*")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("day", "feature").agg(
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"), F.max("value").alias("high"))


def merge_sketches(sketches: DataFrame, by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(by..., sketch, n, low, high) over all rows of each group, by default over all days of a feature."""
    return sketches.groupBy(*(by or ["feature"])).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"), F.min("low").alias("low"),
        F.max("high").alias("high"))


def sketch_quantiles(merged: DataFrame, probs: list[float]) -> DataFrame:
    """The merged rows with ``quantiles``, one a probability; 0 and 1 are the exact extremes."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    exact = F.transform(at, lambda q, i: F.when(F.array(*[F.lit(float(p)) for p in probs])[i] <= 0, F.col("low"))
                        .when(F.array(*[F.lit(float(p)) for p in probs])[i] >= 1, F.col("high")).otherwise(q))
    return merged.withColumn("quantiles", exact)


def sketch_edges(merged: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, edges) as ``operators.drift.bin_edges`` gives them, from sketches: widened at both ends and without
    repeats; equal width where repeats leave fewer than ``n_bins`` bins."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = sketch_quantiles(merged, probs)
    inner = F.array_distinct(F.slice("quantiles", 2, n_bins - 1))
    low, high = F.col("low") - 1e-10, F.col("high") + 1e-10
    inner = F.filter(inner, lambda x: (x > low) & (x < high))
    edges = F.concat(F.array(low), F.array_sort(inner), F.array(high))
    even = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: F.when(i == n_bins, high).otherwise(low + i * ((high - low) / n_bins)))
    return q.select("feature", F.when(F.size(edges) < n_bins + 1, even).otherwise(edges).alias("edges"))


def sketch_fences(merged: DataFrame, factor: float = 1.5) -> DataFrame:
    """(feature, lower, upper): the quartiles less and plus ``factor`` times their distance."""
    q = sketch_quantiles(merged, [0.25, 0.75])
    a, b = F.col("quantiles")[0], F.col("quantiles")[1]
    return q.select("feature", (a - factor * (b - a)).alias("lower"), (b + factor * (b - a)).alias("upper"))
