"""Distributed rank / prefix sum / quantiles are exact, skew-safe and partition-invariant."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.functions.prefix import global_order, top_k_per_group
from churnlens.functions.quantiles import grouped_quantiles, quantiles


def _data(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    # a third of the rows share one hot value
    rows = [(i, 7.0 if i % 3 == 0 else float(rnd.randint(0, 500)), i % 4) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, v double, g long")


@pytest.mark.parametrize("n_parts", [1, 64, 512])
def test_global_rank_and_sums_exact(spark, n_parts):
    rows, df = _data(spark)
    out = global_order(df, [("v", False), ("id", True)], sums={"cum": "v"}, n_parts=n_parts) \
        .select("id", "_rank", "cum").collect()
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(exp)}
    cum, acc = {}, 0.0
    for r in exp:
        acc += r[1]
        cum[r[0]] = acc
    got = {r["id"]: (r["_rank"], r["cum"]) for r in out}
    assert all(got[k][0] == rank[k] and abs(got[k][1] - cum[k]) < 1e-6 for k in rank)


def test_partitioned_rank(spark):
    rows, df = _data(spark)
    out = global_order(df, [("v", True), ("id", True)], partition_by=["g"], sums={"cum": "v"},
                       n_parts=13).collect()
    for g in range(4):
        sub = sorted([r for r in rows if r[2] == g], key=lambda r: (r[1], r[0]))
        exp = {r[0]: i + 1 for i, r in enumerate(sub)}
        got = {r["id"]: r["_rank"] for r in out if r["g"] == g}
        assert got == exp


def test_partition_invariance(spark):
    _, df = _data(spark)
    res = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res.append(sorted(global_order(df, [("v", True), ("id", True)], n_parts=None if parts == "1" else 5)
                          .select("id", "_rank").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1]


def test_ranks_over_float_sums_have_no_gaps(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i % 700, rnd.random() / 3) for i in range(20_000)], "id long, x double").repartition(16)
    summed = df.groupBy("id").agg(F.sum("x").alias("v"))
    got = sorted(r["_rank"] for r in global_order(summed, [("v", True), ("id", True)], n_parts=40).collect())
    assert got == list(range(1, 701))


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "g") for i in range(20)], "id long, g string")
    got = global_order(df, [("id", True)], partition_by=["g"], n_parts=3).collect()
    assert sorted((r["g"] or "", r["_rank"]) for r in got) == sorted((g, k) for g in ("", "g") for k in range(1, 11))


def test_quantiles_match_numpy(spark):
    rows, df = _data(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = quantiles(df, "v", probs)
    exp = np.percentile([r[1] for r in rows], [p * 100 for p in probs])
    assert np.allclose(got, exp)
    g = {(r["g"], r["q_index"]): r["q"] for r in grouped_quantiles(df, "v", [0.5], ["g"]).collect()}
    for k in range(4):
        assert abs(g[(k, 0)] - np.median([r[1] for r in rows if r[2] == k])) < 1e-9


def test_top_k_salted(spark):
    rows, df = _data(spark)
    out = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5, salt_col="id").collect()
    for k in range(4):
        exp = [r[0] for r in sorted([r for r in rows if r[2] == k], key=lambda r: (-r[1], r[0]))[:5]]
        got = [r["id"] for r in sorted([r for r in out if r["g"] == k], key=lambda r: r["_rn"])]
        assert got == exp
