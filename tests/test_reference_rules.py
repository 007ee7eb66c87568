"""Rules worked out by hand from the reference's definitions, one small frame each."""
import pytest
from pyspark.sql import functions as F

from churnlens.operators import budget, cohort, drift, models, recommend, report, scoring, segment, stats, survival, uplift


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_uplift_segments(spark):
    rows = [("a", -0.01, 0.9), ("b", 0.2, 0.5), ("c", 0.2, 0.49), ("d", 0.05, 0.9), ("e", 0.0, 0.1), ("f", -0.3, 0.1)]
    df = spark.createDataFrame(rows, "customer_id string, uplift_score double, churn_probability double")
    assert by(uplift.uplift_segments(df), "customer_id", "uplift_segment") == {
        "a": "sleeping_dog", "b": "persuadable", "c": "sure_thing", "d": "lost_cause", "e": "sure_thing", "f": "sleeping_dog"}
    # Median 0: no inner classes; then a positive and a negative median.
    assert by(uplift.uplift_segments_median(df), "customer_id", "uplift_segment")["a"] == "sleeping_dog"
    pos = spark.createDataFrame([(i, x) for i, x in enumerate((-0.1, 0.1, 0.2, 0.3, 0.0))], "customer_id long, uplift_score double")
    assert by(uplift.uplift_segments_median(pos), "customer_id", "uplift_segment") == {
        0: "sleeping_dog", 1: "persuadable", 2: "persuadable", 3: "persuadable", 4: "sure_thing"}
    neg = spark.createDataFrame([(i, x) for i, x in enumerate((-0.3, -0.2, -0.1, 0.1, -0.4))], "customer_id long, uplift_score double")
    assert by(uplift.uplift_segments_median(neg), "customer_id", "uplift_segment") == {
        0: "sleeping_dog", 1: "lost_cause", 2: "lost_cause", 3: "persuadable", 4: "sleeping_dog"}


def test_persuadable_report(spark):
    df = spark.createDataFrame([("a", "persuadable", 4.0, 1.0, 0.3, 0.8), ("b", "persuadable", 6.0, 1.0, 0.5, 0.6),
                                ("c", "lost_cause", 1.0, 9.0, 0.0, 0.9)],
                               "customer_id string, uplift_segment string, x double, y double, uplift_score double, "
                               "churn_probability double")
    lift = uplift.persuadable_lift(df, ["x", "y"]).collect()
    assert [(r["feature"], r["lift"], r["abs_lift"]) for r in lift] == [("y", -8.0, 8.0), ("x", 4.0, 4.0)]
    assert by(uplift.persuadable_customers(df), "customer_id", "rank") == {"b": 1, "a": 2}
    s = uplift.persuadable_summary(df).first()
    assert (s["persuadable_count"], s["persuadable_mean_uplift"]) == (2, pytest.approx(0.4))


def test_budget_rules(spark):
    df = spark.createDataFrame([("a", 0.2, 1000.0, 0.5, 100.0, 50.0, "vip"), ("b", -0.1, 1000.0, 0.5, 100.0, 100.0, "vip"),
                                ("c", 0.1, 500.0, 2.0, 100.0, 200.0, "x_Sleeping_Dog")],
                               "customer_id string, uplift_score double, clv double, churn_probability double, "
                               "cost_per_action double, allocated_budget double, segment string")
    m = budget.budget_metrics(df)
    # half a treatment: .5 * .2 * .5; a churn of 2 counts as 1
    assert by(m, "customer_id", "expected_retained") == {"a": 0.05, "b": 0.0, "c": 0.1}
    assert by(m, "customer_id", "priority_score") == {"a": 200.0, "b": 0.0, "c": 50.0}
    na = budget.no_action(m).collect()
    assert {r["customer_id"] for r in na if r["no_action"]} == {"b", "c"}
    assert all(r["allocated_budget"] == r["revenue_saved"] == r["expected_retained"] == r["roi"] == 0 for r in na if r["no_action"])
    p = budget.project(df.drop("allocated_budget", "segment"), df.filter("customer_id = 'a'")).first()
    assert p["revenue_impact"] == pytest.approx(0.5 * 0.2 * 1000 * 0.5)
    none = budget.allocate_proportional(df.withColumn("uplift_score", F.lit(-1.0)), 100.0)
    assert [r["allocated_budget"] for r in none.collect()] == [0.0] * 3
    ch = spark.createDataFrame([("x", 0.5, 1.0), ("y", 300.0, 2.0)], "channel string, unit_cost double, multiplier double")
    got = {r["channel"]: (r["channel_budget"], r["expected_actions"]) for r in budget.channel_split(ch, 1000.0).collect()}
    assert got == {"x": (333, 333), "y": (666, 2)}


def test_recommendation_context_and_offers(spark):
    recs = spark.createDataFrame([("a", "no_action", 0.0, 0.0, 0.1, 2000.0, 0.9, None, 7.0), ("b", "mystery", 0.4, 10.0, -0.2, 100.0, 1.5, "x", 3.0)],
                                 "customer_id string, action_type string, score double, estimated_cost double, uplift_score double, "
                                 "clv double, churn_probability double, segment string, priority_score double")
    c = recommend.decision_context(recs)
    assert by(c, "customer_id", "expected_revenue_saved") == {"a": 0.0, "b": 0.0}
    o = {r["customer_id"]: r for r in recommend.offers(c).collect()}
    assert (o["a"]["segment"], o["a"]["priority_score"], o["a"]["expected_uplift"]) == ("unknown", 7.0, 0.1)
    assert o["a"]["offer_detail"] == recommend.OFFER_DETAILS["no_action"]
    assert (o["b"]["offer_detail"], o["b"]["expected_uplift"], o["b"]["churn_probability"]) == (recommend.DEFAULT_DETAIL, -0.2, 1.0)
    s = spark.createDataFrame([(1, 0.5, None, 0.2), (2, None, 10.0, 0.1)], "customer_id long, churn_probability double, clv double, uplift_score double")
    none = spark.createDataFrame([], "customer_id long, segment string")
    pred = spark.createDataFrame([(1, 70.0)], "customer_id long, predicted_clv double")
    r = {x["customer_id"]: x for x in recommend.recommend_input(s, none, none, pred).collect()}
    assert (r[1]["segment"], r[1]["uplift_segment"], r[1]["clv"], r[1]["priority_score"]) == ("general", "unknown", 70.0, pytest.approx(14.0))
    assert recommend.recommend_input(s, none, none).filter("customer_id = 1").first()["clv"] == 50000.0


def test_monitoring_levels(spark):
    psi = spark.createDataFrame([("a", 0.3, "red"), ("b", 0.12, "yellow"), ("c", 0.01, "green")], "feature string, psi double, level string")
    ks = spark.createDataFrame([("c", 0.2, 0.001, "drift"), ("d", 0.1, 0.5, "ok")],
                               "feature string, ks_statistic double, p_value double, level string")
    perf = spark.createDataFrame([("m", "auc", "degraded")], "model string, metric string, status string")
    m = drift.monitor(psi, ks, perf).first()
    assert (m["overall_alert_level"], m["drifted_features"]) == ("red", ["a", "c"])
    assert drift.monitor(psi.filter("feature = 'c'"), ks.filter("feature = 'd'"), perf.limit(0)).first()["overall_alert_level"] == "green"
    h = {r["feature_name"]: r for r in drift.drift_history_rows(psi, ks, F.lit("2024-01-01").cast("date")).collect()}
    assert {k: r["alert_level"] for k, r in h.items()} == {"a": "red", "b": "yellow", "c": "yellow", "d": "green", "__overall__": "yellow"}
    assert h["d"]["psi"] == 0.0 and h["__overall__"]["psi"] == pytest.approx(0.1075) and h["a"]["num_drifted_features"] == 2


def test_cluster_names_use_average_ranks():
    # Composite -R + F + M: cluster 0 best; 1 and 2 tie at places 2.5, both named by place 2.
    means = {0: (1, 9, 9), 1: (5, 5, 5), 2: (5, 5, 5), 3: (9, 1, 1)}
    assert segment.cluster_names(means) == {0: "vip_loyal", 1: "loyal_customer", 2: "loyal_customer", 3: "at_risk"}


def test_assignment_takes_any_id_and_seeds_differ(spark):
    text = spark.createDataFrame([(f"cust_{i}",) for i in range(200)], "customer_id string")
    large = spark.createDataFrame([(4_000_000_000 + i,) for i in range(200)], "customer_id long")
    for ids in (text, large):
        a, b = (by(stats.assign_groups(ids, 0.5, 2, seed), "customer_id", "group") for seed in (42, 43))
        assert sorted(a.values()).count("treatment") == 100
        assert 60 < sum(a[k] != b[k] for k in a) < 140


def test_experiment_summary_lift(spark):
    def lift(t, c):
        rows = [("treatment", x) for x in t] + [("control", x) for x in c]
        return stats.experiment_summary(spark.createDataFrame(rows, "group string, v double"), "v", with_test=False).first()["relative_lift"]
    assert lift([1.0, 3.0], [-4.0, -4.0]) == 1.5 and lift([1.0, 1.0], [0.0, 0.0]) == float("inf") and lift([0.0], [0.0]) == 0.0


def test_readout_gate(spark):
    t = spark.createDataFrame([("big", 20000, 20000, 0.10, 0.20), ("small", 50, 50, 0.10, 0.20), ("worse", 20000, 20000, 0.3, 0.2)],
                              "experiment string, n_a long, n_b long, mean_a double, mean_b double")
    r = stats.experiment_readout(t)
    assert by(r, "experiment", "is_significant") == {"big": True, "small": False, "worse": False}
    assert by(r, "experiment", "statistically_significant")["worse"] and by(r, "experiment", "is_underpowered")["small"]
    s = stats.readout_summary(r).first()
    assert (s["total_experiments"], s["significant_count"], s["best_experiment"]) == (3, 1, "big")
    assert s["avg_lift"] == pytest.approx((0.5 + 0.5 - 0.5) / 3)


def test_roc_and_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 0), (0.5, 1)], "churn_probability double, churn_label int")
    pts = sorted((r["fpr"], r["tpr"]) for r in models.roc_curve(df).collect())
    # (0, 0), then corners only: 0.9 is kept as the first, 0.7 lies on the line to 0.6
    assert pts == [(0.0, 0.0), (0.0, pytest.approx(1 / 3)), (0.0, pytest.approx(2 / 3)), (1.0, pytest.approx(2 / 3)), (1.0, 1.0)]
    tie = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1)], "churn_probability double, churn_label int")
    best = [r["threshold"] for r in models.threshold_table(tie).collect() if r["is_best"]]
    assert best == [0.6]


def test_survival_frame_and_origin(spark):
    p = spark.createDataFrame([(1, 0.1), (2, 1.0)], "customer_id long, churn_probability double")
    assert by(survival.proxy_survival(p), "customer_id", "duration") == {1: 328.0, 2: 1.0}     # 328.5 to even
    d = spark.createDataFrame([(2.0, 1), (3.0, 0)], "duration double, event int")
    k = {r["time"]: (r["at_risk"], r["survival"]) for r in survival.km_curve(d).collect()}
    assert k[0.0] == (2, 1.0) and k[2.0] == (2, 0.5)


def test_report_rules(spark):
    u = spark.createDataFrame([(1, 0.1, 0.1, "x"), (2, -0.1, 0.1, "x"), (3, 0.0, -0.1, "x"), (4, 0.1, -0.1, "x"), (5, -1.0, -1.0, "persuadable")],
                              "id long, uplift_score double, treatment_effect double, uplift_segment string")
    assert by(report.response_class(u), "id", "response_class") == {
        1: "Persuadable", 2: "Sure Thing", 3: "Lost Cause", 4: "Sleeping Dog", 5: "Persuadable"}
    c = spark.createDataFrame([("a", 10.0, 0.0), ("a", 30.0, 0.0)], "action_type string, estimated_cost double, uplift_score double")
    assert report.action_cost(c).first()["cost_per_uplift"] == pytest.approx(20 / 0.001)


def test_scoring_history_grid(spark):
    pred = spark.createDataFrame([(i, 0.5) for i in range(5)], "customer_id long, churn_probability double")
    h = scoring.scoring_history(pred, 5, "2024-01-02 00:00:00")
    assert sorted(r["timestamp"].hour for r in h.collect()) == [0, 0, 6, 12, 18]      # both ends
    assert set(h.columns) >= {"scored_at", "risk_level", "model_version", "segment", "predicted_clv", "data_source"}


def test_sequences_are_bounded(spark):
    ev = spark.createDataFrame([(1, i, "e%d" % (i % 2)) for i in range(10)], "customer_id long, event_id long, event_type string") \
        .withColumn("event_date", F.lit("2024-01-01").cast("date"))
    cu = spark.createDataFrame([(1, 1)], "customer_id long, churn_label int")
    assert cohort.churn_sequences(ev, cu, max_events=3).first()["sequence"] == "e1 -> e0 -> e1"


def test_long_sequences_are_whole(spark):
    # Two customers whose long sequences differ in the first event only; a third has a short one.
    n = 10_001
    ev = spark.range(2 * n).select((F.col("id") % 2).alias("customer_id"), F.floor(F.col("id") / 2).alias("event_id")) \
        .withColumn("event_type", F.when(F.col("event_id") == 0, F.concat(F.lit("s"), "customer_id")).otherwise(F.lit("x")))
    ev = ev.unionByName(spark.createDataFrame([(7, 0, "z")], "customer_id long, event_id long, event_type string"))
    ev = ev.withColumn("event_date", F.lit("2024-01-01").cast("date"))
    cu = spark.createDataFrame([(c, 1) for c in (0, 1, 7)], "customer_id long, churn_label int")
    got = [(r["sequence"], r["count"]) for r in cohort.churn_sequences(ev, cu).collect()]
    assert got == [(" -> ".join([f"s{c}"] + ["x"] * (n - 1)), 1) for c in (0, 1)] + [("z", 1)]


@pytest.mark.parametrize("types", [["a", "b", None, ""], ["a", "a -> b", "b", "b ->", None, ""]])
def test_sequences_match_brute_force(spark, types, monkeypatch):
    import random
    from collections import Counter
    monkeypatch.setattr(cohort, "PREFIX_EVENTS", 3)
    rng = random.Random(6)
    rows = [(c, i, rng.choice(types)) for c in range(60) for i in range(rng.randint(1, 2 + c // 10))]
    by_customer = {}
    for c, _, t in rows:
        by_customer.setdefault(c, []).append(t)
    want = Counter(" -> ".join(t for t in ts if t is not None) for ts in by_customer.values())
    want.pop("", None)
    ev = spark.createDataFrame(rows, "customer_id long, event_id long, event_type string") \
        .withColumn("event_date", F.lit("2024-01-01").cast("date"))
    cu = spark.createDataFrame([(c, 1) for c in by_customer], "customer_id long, churn_label int")
    for top_n in (1, 5, 20):
        got = [(r["sequence"], r["count"]) for r in cohort.churn_sequences(ev, cu, top_n=top_n).collect()]
        assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:top_n]
