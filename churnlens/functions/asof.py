"""As-of lookup as a merge: for each row the last earlier observation of its group.

Both sides are put into one order of (group, time, side, tie) and range-partitioned by it, so a group of any
size is split over tasks and no row meets more than its own partition. The last observation is carried forward
by a window within the partition; what a partition starts with comes from a table with one row a
partition and group, filled forward the same way. There is no join on a condition of times, and rows
without an observation keep nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import cut_lineage


def asof(rows: DataFrame, observations: DataFrame, time: str, obs_time: str, values: list[str],
         by: list[str] | None = None, tie: list[str] | None = None, n_parts: int | None = None) -> DataFrame:
    """``rows`` with the ``values`` and ``obs_time`` of the last observation with ``obs_time <= time``.

    ``by``: columns of both sides (null is a group of its own); ``tie``: columns of the
    observations that order those of one time, the last one counts. Rows with a null time and
    observations with a null time match nothing; repeated rows are answered each; columns of ``rows``
    named like a value are replaced (the names of ``time`` and ``by`` must differ from them).
    """
    by, tie = list(by or []), list(tie or [])
    spark = rows.sparkSession
    parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k).alias(f"__g{i}") for i, k in enumerate(by)]
    groups = [f"__g{i}" for i in range(len(by))]
    seen = F.struct(F.col(obs_time).alias("__time"), *[F.col(v) for v in values])
    kind = observations.select(seen.alias("x")).schema["x"].dataType
    keep = [c for c in rows.columns if c in (time, *by) or c not in (obs_time, *values)]
    row = F.struct(*[F.col(c) for c in keep])
    row_kind = rows.select(row.alias("x")).schema["x"].dataType
    order_by = F.struct(*[F.col(c) for c in [*tie, *values]] or [F.col(obs_time)])
    tie_kind = observations.select(order_by.alias("x")).schema["x"].dataType
    # Observations come before the rows of their time; a row with a null time stays, without an answer.
    left = rows.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(tie_kind).alias("__tie"),
                       F.lit(None).cast(kind).alias("__seen"), row.alias("__row"))
    right = observations.filter(F.col(obs_time).isNotNull()).select(
        *keys, F.col(obs_time).alias("__t"), F.lit(0).alias("__side"), order_by.alias("__tie"), seen.alias("__seen"),
        F.lit(None).cast(row_kind).alias("__row"))
    order = [*[F.col(g).asc() for g in groups], F.col("__t").asc(), F.col("__side").asc(), F.col("__tie").asc()]
    # Equal rows of one time may be many: a hash of the row deals them out.
    dealt = left.unionByName(right).withColumn("__spread", F.xxhash64("__row"))
    dealt = dealt.repartitionByRange(parts, *order, F.col("__spread").asc())
    dealt = cut_lineage(dealt.withColumn("__b", F.spark_partition_id()).drop("__spread"))
    last = F.last("__seen", ignorenulls=True)
    w = Window.partitionBy("__b", *groups).orderBy(F.col("__t").asc(), F.col("__side").asc(), F.col("__tie").asc())
    inside = last.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = F.max(F.when(F.col("__seen").isNotNull(), F.struct("__t", "__tie", "__seen")))
    ends = dealt.groupBy("__b", *groups).agg(top["__seen"].alias("__end"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__b").alias("__cb"), *[F.col(g).alias(f"__c{g}") for g in groups],
                          F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    filled = dealt.withColumn("__seen", inside).filter(F.col("__side") == 1)
    same: list[Column] = [F.col(g).eqNullSafe(F.col(f"__c{g}")) for g in groups]
    joined = filled.join(carried, reduce(Column.__and__, same, F.col("__b") == F.col("__cb")), "left")
    answer = F.when(F.col("__t").isNotNull(), F.coalesce("__seen", "__carry"))
    return joined.select(F.col("__row.*"), *[answer[c].alias(n) for c, n in [("__time", obs_time), *[(v, v) for v in values]]])
