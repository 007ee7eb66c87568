"""Exact KS p-values of many features: together as one by one, and dealt over the tasks."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.functions import special as sf
from churnlens.operators import drift as dr


def one_by_one(d, n1, n2):
    """Share of the lattice paths that leave the band, counted in whole numbers."""
    top = round(d * n1 * n2)
    if top <= 0:
        return 1.0
    inside = {0: 1}
    for t in range(1, n1 + n2 + 1):
        new = {}
        for x in range(max(0, t - n2), min(n1, t) + 1):
            if abs(x * n2 - (t - x) * n1) < top:
                new[x] = inside.get(x, 0) + inside.get(x - 1, 0)
        inside = new
    return 1 - inside.get(n1, 0) / math.comb(n1 + n2, n1)


def test_many_tests_equal_single_ones():
    rng = np.random.default_rng(3)
    n1, n2 = rng.integers(1, 60, 300), rng.integers(1, 60, 300)
    d = rng.integers(0, np.lcm(n1, n2) + 1) / np.lcm(n1, n2)
    got = sf.ks_pvalues(d, n1.astype(float), n2.astype(float))
    assert got == pytest.approx([one_by_one(*map(lambda v: v.item(), x)) for x in zip(d, n1, n2)], abs=1e-12)
    odd = sf.ks_pvalues(np.array([np.nan, 0.1, 0.1]), np.array([5.0, 0.0, 20_000.0]), np.array([5.0, 5.0, 20_000.0]))
    assert np.isnan(odd[:2]).all() and odd[2] == sf.kolmogorov_sf(10.0)


def test_p_values_are_dealt_over_the_tasks(spark):
    long = spark.range(40 * 20).select((F.col("id") % 40).cast("string").alias("feature"), (F.col("id") * 7 % 11).cast("double").alias("value"))
    out = dr.ks_by_feature(long.filter("value < 6"), long.filter("value > 3"))
    tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 40
