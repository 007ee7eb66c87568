"""Exact p-values against enumeration, and the tests on frames without variance or without rows."""
import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnlens.functions import special as sf
from churnlens.operators import drift as dr
from churnlens.operators import models as mo
from churnlens.operators import report as rp
from churnlens.operators import stats as st


def ks_enumerated(n1, n2):
    """{D * n1 * n2: number of orders} over all ways to mix two samples."""
    out = Counter()
    for places in itertools.combinations(range(n1 + n2), n1):
        x = y = top = 0
        mine = set(places)
        for i in range(n1 + n2):
            x, y = x + (i in mine), y + (i not in mine)
            top = max(top, abs(x * n2 - y * n1))
        out[top] += 1
    return out


@pytest.mark.parametrize("n1", range(1, 9))
def test_ks_exact_is_enumeration(n1):
    for n2 in range(1, n1 + 1):
        found = ks_enumerated(n1, n2)
        total = sum(found.values())
        for top in found:
            want = sum(c for d, c in found.items() if d >= top) / total
            d = top / (n1 * n2)
            assert sf.ks_exact_sf(d, n1, n2) == pytest.approx(want, rel=1e-12)
            assert sf.ks_exact_sf(d, n2, n1) == pytest.approx(want, rel=1e-12)


def test_ks_exact_of_large_samples():
    # No common value: one path each way.
    assert sf.ks_exact_sf(1.0, 40, 30) == pytest.approx(2 / math.comb(70, 30), rel=1e-10)
    for n1, n2, d in [(2000, 2000, 0.04), (5000, 3000, 0.03), (10_000, 10_000, 0.02)]:
        assert sf.ks_exact_sf(d, n1, n2) == pytest.approx(sf.kolmogorov_sf(math.sqrt(n1 * n2 / (n1 + n2)) * d), rel=0.05)
    assert sf.ks_exact_sf(0.0, 5, 5) == 1.0 and math.isnan(sf.ks_pvalue(0.1, 0, 5))


@pytest.mark.parametrize("n1, n2", [(m, n) for m in range(1, 9) for n in range(1, 9)])
def test_mann_whitney_exact_is_enumeration(n1, n2):
    found = Counter(sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1))
    total = math.comb(n1 + n2, n1)
    for u in range(n1 * n2 + 1):
        least = min(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(c for x, c in found.items() if x <= least) / total)
        assert sf.mann_whitney_exact(u, n1, n2) == pytest.approx(want, rel=1e-12)


def test_mann_whitney_exact_with_one_large_arm():
    # One value among n: its rank is uniform.
    assert sf.mann_whitney_exact(500, 1, 100_000) == pytest.approx(2 * 501 / 100_001, rel=1e-9)
    z = lambda u, m, n: (m * n / 2 - u - 0.5) / math.sqrt(m * n * (m + n + 1) / 12)
    assert sf.mann_whitney_exact(55_000, 8, 20_000) == pytest.approx(2 * sf.norm_sf(z(55_000, 8, 20_000)), rel=0.05)
    assert sf.mann_whitney_p(5, 9, 9, 0, 1.0) == pytest.approx(2 * sf.norm_sf(1.0))
    assert sf.mann_whitney_p(5, 8, 9, 6, 1.0) == pytest.approx(2 * sf.norm_sf(1.0))


def arms(spark, a, b):
    rows = [("treatment", float(x), 0.0) for x in a] + [("control", float(x), 0.0) for x in b]
    return spark.createDataFrame(rows, "group string, m double, zero double")


def test_mann_whitney_by_group(spark):
    df = arms(spark, [1, 2, 3, 10], [4, 5, 6, 7, 8]).withColumn("g", F.lit("x")).unionByName(
        arms(spark, [1, 1], [1]).withColumn("g", F.lit("ties"))).unionByName(arms(spark, [1], []).withColumn("g", F.lit(None).cast("string")))
    by = {r.g: r for r in st.mann_whitney(df, "m", by=["g"]).collect()}
    assert by["x"].test_statistic == 5 and by["x"].p_value == pytest.approx(sf.mann_whitney_exact(5, 4, 5))
    assert (by["x"].median_a, by["x"].median_b) == (2.5, 6.0) and by["ties"].p_value == 1.0
    assert by[None].test_statistic is None and by[None].p_value is None and by[None].effect_size == 0
    whole = st.mann_whitney(arms(spark, [1, 2, 3, 10], [4, 5, 6, 7, 8]), "m").first()
    assert whole.p_value == by["x"].p_value


@pytest.mark.parametrize("equal_var", [False, True])
def test_constant_metric_has_an_undefined_t(spark, equal_var):
    r = st.t_test(arms(spark, [3, 3, 3], [3, 3]), "m", equal_var=equal_var).first()
    assert r.test_statistic is None and r.p_value is None and r.effect_size == 0
    r = st.t_test(arms(spark, [4, 4, 4], [3, 3]), "m", equal_var=equal_var).first()
    assert r.test_statistic == float("inf") and r.p_value == 0
    for a, b in ([], []), ([1], [2, 3]), ([], [1, 2]), ([1], [2]):
        assert st.t_test(arms(spark, a, b), "m", equal_var=equal_var).first().p_value is None or len(a) + len(b) > 2


def test_summary_and_router_of_a_constant_metric(spark):
    df = arms(spark, [3, 3, 3], [3, 3])
    assert st.significance(df, "m").first().p_value is None
    r = st.experiment_summary(df, "m").first()
    assert r.p_value is None and r.difference == 0 and not r.is_significant


def test_one_constant_metric_leaves_the_others(spark):
    df = arms(spark, [1, 5, 9], [2, 2, 4]).withColumns({"same": F.lit(7.0), "none": F.lit(None).cast("double")})
    for method in ("fdr_bh", "holm", "bonferroni"):
        rows = {r.metric: r for r in st.multi_test(df, ["m", "zero", "same", "none"], method=method).collect()}
        assert rows["zero"].test_statistic == 0 and rows["zero"].p_value == 1
        assert rows["same"].p_value is None and rows["same"].p_adjusted is None and not rows["same"].significant
        assert rows["none"].p_adjusted is None
        alone = st.t_test(df, "m").first().p_value
        assert rows["m"].p_value == pytest.approx(alone) and rows["m"].p_adjusted == pytest.approx(min(1, 2 * alone))


def windows(spark):
    ref = spark.createDataFrame([(float(i), float(i), None, "a" if i % 2 else "b", None) for i in range(40)],
                                "good double, gone double, never double, cat string, nocat string")
    prod = spark.createDataFrame([(float(i), None, 1.0, None, "a") for i in range(20)], ref.schema)
    return ref, prod


def test_windows_without_values(spark):
    ref, prod = windows(spark)
    ks = {r.feature: r for r in dr.ks_two_sample(ref, prod, ["good", "gone", "never"]).collect()}
    assert ks["good"].ks_statistic == 0.5 and ks["good"].p_value == pytest.approx(sf.ks_exact_sf(0.5, 40, 20))
    assert ks["gone"].ks_statistic is None and ks["gone"].p_value is None and (ks["gone"].n_ref, ks["gone"].n_prod) == (40, 0)
    assert ks["never"].ks_statistic is None
    chi = {r.feature: r for r in dr.chi_square_drift(ref, prod, ["cat", "nocat"]).collect()}
    assert chi["cat"].chi2_statistic is None and chi["nocat"].chi2_statistic is None and chi["cat"].p_value is None
    levels = {r.feature: r.level for r in dr.ks_report(ref, prod).collect()}
    assert levels == {"good": "drift", "gone": "undefined", "never": "undefined", "cat": "undefined", "nocat": "undefined"}
    empty = dr.ks_two_sample(ref.limit(0), prod.limit(0), ["good"]).first()
    assert empty.ks_statistic is None and (empty.n_ref, empty.n_prod) == (0, 0)


def test_psi_of_windows_outside_the_edges(spark):
    ref, prod = windows(spark)
    far = prod.withColumns({"good": F.lit(1000.0)})
    psi = {r.feature: r.psi for r in dr.psi(ref, far, ["good", "gone", "never"]).collect()}
    # Every bin of the reference has a tenth, every bin of an empty production epsilon, which is a tenth after scaling.
    assert psi == pytest.approx({"good": 0.0, "gone": 0.0})
    rep = dr.psi_report(ref, far, ["good", "gone"])
    both = dr.monitor(rep, dr.ks_report(ref, far), dr.performance_alerts(spark.createDataFrame(
        [(1, "m", 0.9), (2, "m", 0.5)], "timestamp int, model string, auc double"), {"auc": 0.1}))
    assert both.first().max_rank == 2
    rows = {r.feature_name: r for r in dr.drift_history_rows(rep, dr.ks_two_sample(ref, far, ["good", "gone"]), F.lit(1)).collect()}
    assert rows["gone"].ks_stat == 0 and rows["gone"].alert_level == "green" and rows["good"].alert_level == "yellow"


def test_metrics_without_rows(spark):
    empty = spark.createDataFrame([], "churn_probability double, churn_label int")
    r = mo.binary_metrics(empty).first()
    assert r.accuracy is None and r.roc_auc is None and r.precision == 0 and r.f1 == 0
    r = mo.binary_metrics(spark.createDataFrame([(0.7, 1)], empty.schema)).first()
    assert r.accuracy == 1 and r.roc_auc is None
    shares = rp.cumulative_importance(spark.createDataFrame([("a", 0.0), ("b", 0.0)], "feature string, importance double"))
    assert [r.share for r in shares.collect()] == [0.0, 0.0]
