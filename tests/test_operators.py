"""Operator semantics on small hand-made frames."""
import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from churnlens.operators import budget as bu
from churnlens.operators import cohort as co
from churnlens.operators import segment as sg
from churnlens.operators import stats as st
from churnlens.operators import survival as sv


def test_quantile_score_matches_qcut_rule(spark):
    # n = 12, q = 5: qcut on ranks gives bin sizes 3, 2, 2, 2, 3 (not ntile's 3, 3, 2, 2, 2)
    df = spark.createDataFrame([(i, float(i)) for i in range(12)], "customer_id long, x double")
    got = [r["x_score"] for r in sg.quantile_score(df, "x", 5).orderBy("customer_id").collect()]
    assert [got.count(b) for b in range(1, 6)] == [3, 2, 2, 2, 3]
    inv = [r["x_score"] for r in sg.quantile_score(df, "x", 5, inverse=True).orderBy("customer_id").collect()]
    assert inv == [6 - b for b in got]
    const = spark.createDataFrame([(i, 1.0) for i in range(5)], "customer_id long, x double")
    assert {r["x_score"] for r in sg.quantile_score(const, "x", 5).collect()} == {5}


def _lp_greedy(rows, budget):
    pri = [max(u, 0) * c * p for _, u, c, p, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (-(pri[i] / rows[i][4]), rows[i][0]))
    left, out = budget, {}
    for i in order:
        cap = rows[i][4] if pri[i] > 0 else 0.0
        x = max(0.0, min(cap, left))
        out[rows[i][0]] = x
        left -= x
    return out


def test_budget_matches_fractional_knapsack(spark):
    rows = [(i, (i % 7 - 2) / 10, 100.0 + 13 * i, (i % 5) / 5, [5000.0, 10000.0, 20000.0][i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "customer_id long, uplift_score double, clv double, churn_probability double, "
                                     "cost_per_action double")
    for budget in (0.0, 45000.0, 1e9):
        got = {r["customer_id"]: r["allocated_budget"] for r in bu.allocate(df, budget, residual=False).collect()}
        exp = _lp_greedy(rows, budget)
        assert all(abs(got[k] - exp[k]) < 1e-6 for k in exp)
        assert sum(got.values()) <= budget + 1e-6


def test_budget_brute_force_lp_optimality(spark):
    # the greedy value equals the best vertex of the tiny LP (every fully / partially funded subset)
    rows = [(0, 0.2, 100.0, 0.5, 30.0), (1, 0.1, 400.0, 0.9, 50.0), (2, 0.3, 50.0, 0.4, 10.0), (3, -0.1, 900.0, 0.9, 5.0)]
    df = spark.createDataFrame(rows, "customer_id long, uplift_score double, clv double, churn_probability double, "
                                     "cost_per_action double")
    budget = 60.0
    got = {r["customer_id"]: r["allocated_budget"] for r in bu.allocate(df, budget, residual=False).collect()}
    eff = {r[0]: max(r[1], 0) * r[2] * r[3] / r[4] for r in rows}
    value = sum(eff[k] * v for k, v in got.items())
    best = 0.0
    for perm in itertools.permutations(range(4)):
        left, val = budget, 0.0
        for i in perm:
            x = min(rows[i][4], left) if eff[i] > 0 else 0.0
            val += eff[i] * x
            left -= x
        best = max(best, val)
    assert abs(value - best) < 1e-9


def test_km_all_events_at_once(spark):
    df = spark.createDataFrame([(5.0, 1)] * 4 + [(9.0, 0)], "duration double, event int")
    c = {r["time"]: r["survival"] for r in sv.km_curve(df).collect()}
    assert abs(c[5.0] - 0.2) < 1e-12
    df2 = spark.createDataFrame([(3.0, 1)] * 3, "duration double, event int")
    assert sv.km_curve(df2).collect()[0]["survival"] == 0.0


def test_concordance_matches_brute_force(spark):
    rows = [(float(d), e, float(r)) for d, e, r in
            [(5, 1, 0.9), (8, 0, 0.2), (3, 1, 0.7), (8, 1, 0.7), (12, 0, 0.1), (5, 0, 0.4), (1, 1, 0.95), (12, 1, 0.3)]]
    df = spark.createDataFrame(rows, "duration double, event int, risk double")
    got = sv.concordance(df).first()
    comp = conc = tie = 0
    for a in rows:
        for b in rows:
            if a[1] == 1 and a[0] < b[0]:
                comp += 1
                conc += a[2] > b[2]
                tie += a[2] == b[2]
    assert got["comparable_pairs"] == comp and got["concordant_pairs"] == conc and got["tied_risk"] == tie


def test_cox_recovers_effect_sign(spark):
    rows = []
    for i in range(400):
        x = (i % 20) / 10.0 - 1.0
        rows.append((float(1 + int(100 * math.exp(-1.5 * x) * ((i * 7919) % 97 + 1) / 97)), 1 if i % 5 else 0, x))
    df = spark.createDataFrame(rows, "duration double, event int, x double")
    m = sv.fit_cox(df, ["x"], penalizer=0.0)
    assert m["coef"][0] > 0.5


def test_retention_known_pattern(spark):
    d0 = dt.date(2024, 1, 1)
    rows = []
    for c in range(10):
        rows.append((c, "2024-01", 0))
        if c < 6:
            rows.append((c, "2024-01", 1))
        if c < 3:
            rows.append((c, "2024-01", 3))
    rows.append((3, "2024-01", 4))  # a later return must not raise retention again
    df = spark.createDataFrame(rows, "customer_id long, cohort string, cohort_period int")
    r = {x["cohort_period"]: x["retention"] for x in co.retention(df).collect()}
    assert r == {0: 1.0, 1: 0.6, 3: 0.3, 4: 0.1}
    _ = d0


def test_corrections_hand_values(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "metric string, p_value double")
    bon = {r["metric"]: r["p_adjusted"] for r in st.correct(t, "bonferroni").collect()}
    assert bon == pytest.approx({"a": 0.04, "b": 0.16, "c": 0.12, "d": 0.8})
    bh = {r["metric"]: r["p_adjusted"] for r in st.correct(t, "fdr_bh").collect()}
    assert bh == pytest.approx({"a": 0.04, "b": 0.0533333, "c": 0.0533333, "d": 0.2}, rel=1e-5)
    holm = {r["metric"]: r["p_adjusted"] for r in st.correct(t, "holm").collect()}
    assert holm == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.2})


def test_z_test_degenerate_arm(spark):
    df = spark.createDataFrame([("treatment", 0)] * 5 + [("control", 0)] * 5, "group string, y int")
    r = st.z_test(df, "y").first()
    assert r["test_statistic"] == 0.0 and r["p_value"] == 1.0


def test_km_by_segment_grid_counts_brute_force(spark):
    rows = [(i, "a" if i % 3 else "b", float(1 + (i * 7) % 11), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id long, segment string, duration double, event int")
    grid = [0.0, 3.0, 5.5, 10.0, 20.0]
    got = {(r["segment"], r["t"]): (r["n_at_risk"], r["n_events"])
           for r in sv.km_by_segment(df, "segment", grid).collect()}
    for seg in ("a", "b"):
        sub = [r for r in rows if r[1] == seg]
        for t in grid:
            exp = (sum(1 for r in sub if r[2] >= t), sum(1 for r in sub if r[2] <= t and r[3] == 1))
            assert got[(seg, t)] == exp


def test_adapters_fill_aliases_and_defaults(spark):
    from churnlens.operators import report as rp
    recs = spark.createDataFrame([(1, "coupon", 1.7, -0.2), (2, "mystery", 0.4, 0.3)],
                                 "customer_id long, action_type string, score double, uplift_score double")
    segs = spark.createDataFrame([(1, "dormant")], "customer_id long, segment string")
    got = {r["customer_id"]: r for r in rp.adapt_recommendations(recs, segs).collect()}
    assert got[1]["recommendation_type"] == "coupon" and got[1]["estimated_cost"] == 5000.0
    assert got[2]["estimated_cost"] == float(rp.DEFAULT_ACTION_COST)
    assert got[1]["priority_score"] == 1.0 and got[1]["expected_uplift"] == 0.0
    assert got[1]["segment"] == "dormant" and got[2]["segment"] == "vip_loyal"
    scen = spark.createDataFrame([(100.0, 250.0), (0.0, 10.0)], "allocated_budget double, retained_value double")
    b = rp.adapt_budget(scen).collect()
    assert [r["segment"] for r in b] == ["scenario_1", "scenario_2"]
    assert [r["roi"] for r in b] == [2.5, 0.0]
    assert [r["expected_retained"] for r in b] == [0.0, 0.0]
