"""Exact global rank and running sums without an unpartitioned window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task. Here, at every
size, the rows are range-partitioned by the full composite key (a hot value is split by its
tie-breaking keys), numbered by partition and checkpointed once, so that all later steps see the
same partitions. Counts and sums per partition (one row a partition, or a partition and group)
give the offsets at which each partition starts; a window within the partition adds them.

The keys must be non-null and together define a total order (end them with a unique id) for
the rank to be exact; the partition bounds only balance the load. ``partition_by`` ranks within
groups by putting the group keys first; null is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import cut_lineage


def global_order(df: DataFrame, keys: list[tuple[str, bool]], *, rank_col: str | None = "_rank",
                 sums: dict[str, str | Column] | None = None,
                 partition_by: list[str] | None = None, totals: dict[str, str] | None = None,
                 n_parts: int | None = None) -> DataFrame:
    """Add a 1-based rank in the order ``keys`` and inclusive running sums.

    ``keys``: ``[(column, ascending), ...]``; ``sums``: ``{out_name: column}``.
    With ``partition_by`` the rank and sums restart for each group. ``totals``: ``{out_name: name
    in sums}`` adds the whole (group's) sum to every row.
    """
    groups = list(partition_by or [])
    order = [F.col(k).asc() if a else F.col(k).desc() for k, a in keys if k not in groups]
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tmp = {out: f"__s{i}" for i, out in enumerate(sums or {})}
    work = df.withColumns({tmp[out]: (F.col(c) if isinstance(c, str) else c).cast("double")
                           for out, c in (sums or {}).items()})
    dealt = work.repartitionByRange(n_parts, *[F.col(g).asc() for g in groups], *order)
    dealt = cut_lineage(dealt.withColumn("__b", F.spark_partition_id()))
    starts = {"__n": "__n_before", **{t: f"{t}_before" for t in tmp.values()}}
    whole = {o: tmp[name] for o, name in (totals or {}).items()}
    per_part = dealt.groupBy("__b", *groups).agg(F.count(F.lit(1)).alias("__n"),
                                               *[F.sum(t).alias(t) for t in tmp.values()])
    if groups:
        before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_part.select(F.col("__b").alias("__ob"), *[F.col(g).alias(f"__o_{g}") for g in groups],
                                *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(s) for c, s in starts.items()],
                                *[F.sum(c).over(Window.partitionBy(*groups)).alias(o) for o, c in whole.items()])
        # One row a partition and group: spread by partition, so no group is a hot key.
        same = [dealt[g].eqNullSafe(offsets[f"__o_{g}"]) for g in groups]
        out = dealt.join(offsets, reduce(Column.__and__, same, dealt["__b"] == offsets["__ob"]))
        out = out.drop("__ob", *[f"__o_{g}" for g in groups])
    else:
        rows, run = [], dict.fromkeys(starts, 0)
        for r in sorted(per_part.collect(), key=lambda r: r["__b"]):     # one row a partition
            rows.append((r["__b"], *[run[c] for c in starts]))
            run = {c: run[c] + (r[c] or 0) for c in starts}
        schema = "__b int, __n_before long" + "".join(f", {t}_before double" for t in tmp.values())
        rows = [(b, n, *map(float, rest)) for b, n, *rest in rows]
        out = dealt.join(F.broadcast(spark.createDataFrame(rows, schema)), "__b")
        out = out.withColumns({o: F.lit(float(run[c])) for o, c in whole.items()})
    w = Window.partitionBy("__b", *groups).orderBy(*order)
    run_w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if rank_col:
        out = out.withColumn(rank_col, F.row_number().over(w) + F.col("__n_before"))
    for o, t in tmp.items():
        # A sum of nulls only so far is 0.
        out = out.withColumn(o, F.coalesce(F.sum(t).over(run_w), F.lit(0.0)) + F.coalesce(F.col(f"{t}_before"), F.lit(0.0)))
    return out.drop("__b", *starts.values(), *tmp.values())


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "_rn", salt_col: str | None = None, salts: int = 32) -> DataFrame:
    """The k first rows of every group in ``order`` (a total order), skew-safe.

    Phase 1 keeps the top k inside each (group, salt) sub-group, so a hot group is split
    over ``salts`` tasks; phase 2 ranks the at most ``k * salts`` survivors per group.
    ``salt_col`` must be a column that spreads rows (e.g. an event id).
    """
    if salt_col is None:
        w = Window.partitionBy(*group_cols).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "__salt").orderBy(*order)
    cand = salted.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
            .drop("__salt", "__r1"))
