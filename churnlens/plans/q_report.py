"""Queries: reporting aggregates (O1-O25) on the prediction frame (M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.functions.columns import risk_level_right_closed
from churnlens.operators import recommend as rc
from churnlens.operators import report as rp
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.plans.q_budget import BM_SQL, BUDGET_SHARE, alloc_sql
from churnlens.plans.q_recommend import BEST, CTES as REC_CTES, OFFERS, RA, _input
from churnlens.sources import tables as tb


def _pred(spark, sf):
    s = tb.scores(spark, sf)
    p = F.least(F.greatest(F.col("churn_probability"), F.lit(0.0)), F.lit(1.0))
    return s.select("customer_id", p.alias("churn_probability"), risk_level_right_closed(p).alias("risk_level"),
                    "segment", "clv", "uplift_score", "cost_per_action")


PRED = """pred AS (SELECT customer_id, least(greatest(churn_probability, 0.0), 1.0) AS churn_probability,
  CASE WHEN least(greatest(churn_probability, 0.0), 1.0) <= 0.25 THEN 'low'
       WHEN least(greatest(churn_probability, 0.0), 1.0) <= 0.5 THEN 'medium'
       WHEN least(greatest(churn_probability, 0.0), 1.0) <= 0.75 THEN 'high' ELSE 'critical' END AS risk_level,
  segment, clv, uplift_score, cost_per_action FROM scores)"""
V = ["scores"]


def q(name, sql, doubles=(), ints=(), ctes=(), views=V):
    return register(name, oracle(sql, views=list(views), ctes=[PRED, *ctes], doubles=list(doubles), ints=list(ints)))


@q("prediction_frame", "SELECT * FROM pred", ["churn_probability", "clv", "uplift_score", "cost_per_action"])
def q_prediction_frame(spark, sf):
    """M9: clipped probabilities, right-closed risk level, segment."""
    return _pred(spark, sf)


@q("segment_overview", """SELECT segment, count(*) AS customers, avg(churn_probability) AS avg_churn_probability,
  count_if(churn_probability > 0.5) AS high_risk_customers, avg(clv) AS avg_clv FROM pred GROUP BY segment""",
   ["avg_churn_probability", "avg_clv"])
def q_segment_overview(spark, sf):
    """O1: segment risk overview."""
    return rp.segment_overview(_pred(spark, sf))


@q("segment_spread", """SELECT segment, count(*) AS count, avg(churn_probability) AS mean, min(churn_probability) AS min,
  max(churn_probability) AS max, stddev_samp(churn_probability) AS std FROM pred GROUP BY segment""",
   ["mean", "min", "max", "std"])
def q_segment_spread(spark, sf):
    """O2: churn spread per segment."""
    return rp.segment_spread(_pred(spark, sf))


@q("segment_analytics", """SELECT segment, count(*) AS count, avg(churn_probability) AS mean,
  stddev_samp(churn_probability) AS std, count_if(churn_probability > 0.5) AS high_risk_count,
  count_if(churn_probability > 0.75) AS critical_count, median(churn_probability) AS median,
  round(count_if(churn_probability > 0.5) / count(*) * 100.0, 1) AS high_risk_pct
FROM pred GROUP BY segment""", ["mean", "std", "median", "high_risk_pct"])
def q_segment_analytics(spark, sf):
    """O3: churn analytics per segment."""
    return rp.segment_analytics(_pred(spark, sf))


@q("segment_risk", "SELECT segment, risk_level, count(*) AS count FROM pred GROUP BY CUBE (segment, risk_level)")
def q_segment_risk(spark, sf):
    """Segment x risk counts with cube subtotals."""
    return rp.segment_risk(_pred(spark, sf))


@q("clv_tiers", """SELECT CASE WHEN clv >= q3 THEN 'Platinum' WHEN clv >= q2 THEN 'Gold' WHEN clv >= q1 THEN 'Silver'
  ELSE 'Bronze' END AS clv_tier, count(*) AS count, avg(clv) AS avg_clv, sum(clv) AS total_clv,
  avg(churn_probability) AS avg_churn_probability
FROM pred CROSS JOIN (SELECT quantile_cont(clv, 0.25) AS q1, quantile_cont(clv, 0.5) AS q2, quantile_cont(clv, 0.75) AS q3
                      FROM pred) GROUP BY 1""", ["avg_clv", "total_clv", "avg_churn_probability"])
def q_clv_tiers(spark, sf):
    """CLV quartile tiers."""
    return rp.clv_tiers(_pred(spark, sf))


@q("clv_by_segment", """SELECT segment, avg(clv) AS mean, sum(clv) AS sum, count(*) AS count, stddev_samp(clv) AS std,
  median(clv) AS median FROM pred GROUP BY segment HAVING count(*) >= 5""", ["mean", "sum", "std", "median"])
def q_clv_by_segment(spark, sf):
    """CLV by segment."""
    return rp.clv_by_segment(_pred(spark, sf))


CORR_COLS = ["churn_probability", "clv", "uplift_score", "cost_per_action"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM pred")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', corr({a}, {b}) FROM pred")
    return " UNION ALL ".join(parts)


@q("correlations", _corr_sql(), ["correlation"])
def q_correlations(spark, sf):
    """Pairwise Pearson correlations."""
    return rp.correlations(_pred(spark, sf), CORR_COLS)


@q("cumulative_importance", """
SELECT feature, importance, share,
  sum(share) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_share
FROM (SELECT feature, importance, importance / sum(importance) OVER () AS share FROM (
  SELECT column_b AS feature, abs(correlation) AS importance FROM (""" + _corr_sql() + """)
  WHERE column_a = 'churn_probability' AND column_b <> 'churn_probability'))""",
   ["importance", "share", "cumulative_share"])
def q_cumulative_importance(spark, sf):
    """Running share of |correlation with churn probability| as feature importance."""
    c = rp.correlations(_pred(spark, sf), CORR_COLS)
    imp = c.filter((F.col("column_a") == "churn_probability") & (F.col("column_b") != "churn_probability")) \
        .select(F.col("column_b").alias("feature"), F.abs("correlation").alias("importance"))
    return rp.cumulative_importance(imp)


#: A treatment effect beside the uplift, shifted so that all sign combinations occur.
EFFECT = "uplift_score - 0.02 + (customer_id % 5) / 100.0"


@q("uplift_by_segment", f"""SELECT segment, avg(uplift_score) AS avg_uplift, avg({EFFECT}) AS avg_treatment_effect,
  count(*) AS count, count_if(uplift_score > 0) AS persuadable,
  round(count_if(uplift_score > 0) / count(*) * 100.0, 1) AS persuadable_pct FROM pred GROUP BY segment""",
   ["avg_uplift", "avg_treatment_effect", "persuadable_pct"])
def q_uplift_by_segment(spark, sf):
    """Uplift by segment."""
    return rp.uplift_by_segment(_pred(spark, sf).withColumn("treatment_effect", F.expr(EFFECT)))


@q("response_class", f"""SELECT response_class, segment, count(*) AS count FROM (
  SELECT segment, CASE uplift_segment WHEN 'persuadable' THEN 'Persuadable' WHEN 'sure_thing' THEN 'Sure Thing'
      WHEN 'lost_cause' THEN 'Lost Cause' WHEN 'sleeping_dog' THEN 'Sleeping Dog'
      ELSE CASE WHEN uplift_score > 0 AND {EFFECT} > 0 THEN 'Persuadable' WHEN uplift_score <= 0 AND {EFFECT} > 0
        THEN 'Sure Thing' WHEN uplift_score <= 0 AND {EFFECT} <= 0 THEN 'Lost Cause' ELSE 'Sleeping Dog' END END
    AS response_class FROM rin) GROUP BY response_class, segment""", ctes=REC_CTES, views=["cust", "scores"])
def q_response_class(spark, sf):
    """Response class counts by segment."""
    u = _input(spark, sf).withColumn("treatment_effect", F.expr(EFFECT))
    return rp.response_class(u).groupBy("response_class", "segment").agg(F.count(F.lit(1)).alias("count"))


@q("action_cost", """SELECT action_type, sum(estimated_cost) AS total_cost, avg(estimated_cost) AS mean_cost,
  count(*) AS count, avg(uplift_score) AS mean_uplift,
  avg(estimated_cost) / greatest(avg(uplift_score), 0.001) AS cost_per_uplift
FROM recs GROUP BY action_type""", ["total_cost", "mean_cost", "mean_uplift", "cost_per_uplift"],
   ctes=REC_CTES + [RA, BEST], views=["cust", "scores"])
def q_action_cost(spark, sf):
    """Cost per recommended action."""
    return rp.action_cost(rc.recommend(_input(spark, sf)))


@q("offer_roi", """SELECT offer_type, sum(estimated_cost_krw) AS cost, sum(expected_revenue_saved_krw) AS revenue,
  count(*) AS offers, sum(expected_revenue_saved_krw) / greatest(sum(estimated_cost_krw), 1.0) AS roi
FROM offers GROUP BY offer_type""", ["cost", "revenue", "roi"], ctes=REC_CTES + [RA, BEST, OFFERS],
   views=["cust", "scores"])
def q_offer_roi(spark, sf):
    """Offer ROI by offer type."""
    return rp.offer_roi(rc.offers(rc.recommend(_input(spark, sf))))


@q("top_clv", "SELECT * FROM pred ORDER BY clv DESC, customer_id LIMIT 10",
   ["churn_probability", "clv", "uplift_score", "cost_per_action"])
def q_top_clv(spark, sf):
    """Top 10 customers by CLV (a top-k report)."""
    return rp.top_n(_pred(spark, sf), "clv", 10)


@q("risk_value_counts", "SELECT risk_level, count(*) AS count FROM pred GROUP BY risk_level")
def q_value_counts(spark, sf):
    """Risk-level frequency table."""
    return rp.value_counts(_pred(spark, sf), "risk_level")


@q("kpi_delta", """SELECT period, orders, floor(orders) AS value_int,
  round((orders - lag(orders) OVER (ORDER BY period)) / nullif(lag(orders) OVER (ORDER BY period), 0) * 100.0, 1)
    AS pct_change
FROM (SELECT year(o_orderdate) AS period, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1)""",
   ["orders", "value_int", "pct_change"], views=["scores"], ints=["period"])
def q_kpi_delta(spark, sf):
    """Yearly order counts with % change vs the previous year."""
    o = tb.read_table(spark, sf, "orders")
    s = o.groupBy(F.year("o_orderdate").alias("period")).agg(F.count(F.lit(1)).cast("double").alias("orders"))
    return rp.kpi_delta(s, "period", "orders")


@q("prediction_enrichment", """SELECT p.* EXCLUDE (clv), coalesce(o.offer_type, 'no_action') AS offer_type,
  coalesce(o.estimated_cost_krw, 0.0) AS estimated_cost_krw, r.* EXCLUDE (customer_id), coalesce(s.clv, 0.0) AS clv_predicted
FROM pred p LEFT JOIN (SELECT customer_id, arg_max(offer_type, (priority_score, offer_type)) AS offer_type,
    arg_max(estimated_cost_krw, (priority_score, offer_type)) AS estimated_cost_krw FROM offers GROUP BY customer_id) o
  ON o.customer_id = p.customer_id
LEFT JOIN rfm r ON r.customer_id = p.customer_id LEFT JOIN scores s ON s.customer_id = p.customer_id""",
   ["churn_probability", "uplift_score", "cost_per_action", "estimated_cost_krw", "recency", "monetary", "avg_order_value",
    "monetary_per_day", "clv_predicted"], ctes=REC_CTES + [RA, BEST, OFFERS], views=["cust", "scores"])
def q_enrich(spark, sf):
    """Predictions enriched with offers, RFM features and CLV."""
    from churnlens.plans.q_segment import _rfm
    pred = _pred(spark, sf).drop("clv")
    return rp.enrich(pred, rc.offers(rc.recommend(_input(spark, sf))), _rfm(spark, sf), tb.scores(spark, sf))


@q("kpi_header", """SELECT count(*) AS customers, avg(CAST(churn_probability >= 0.5 AS DOUBLE)) AS predicted_churn_rate,
  avg(churn_probability) AS mean_probability, count_if(risk_level = 'high') AS high_risk,
  count_if(risk_level = 'critical') AS critical_risk, sum(clv) AS total_clv,
  median(churn_probability) AS median_probability FROM pred""",
   ["predicted_churn_rate", "mean_probability", "total_clv", "median_probability"])
def q_kpi_header(spark, sf):
    """KPI header."""
    return rp.kpi_header(_pred(spark, sf))


@q("clv_histogram", """SELECT g.bin, mn + g.bin * ((mx - mn) / 20) AS bin_start, mn + (g.bin + 1) * ((mx - mn) / 20) AS bin_end,
  coalesce(c.count, 0) AS count
FROM (SELECT unnest(range(0, 20)) AS bin) g CROSS JOIN (SELECT min(clv) AS mn, max(clv) AS mx FROM pred)
LEFT JOIN (SELECT CAST(CASE WHEN mx > mn THEN least(floor((clv - mn) / (mx - mn) * 20), 19) ELSE 0 END AS INTEGER) AS bin,
             count(*) AS count FROM pred CROSS JOIN (SELECT min(clv) AS mn, max(clv) AS mx FROM pred)
           WHERE clv IS NOT NULL GROUP BY 1) c ON g.bin = c.bin""", ["bin_start", "bin_end"], ints=["bin"])
def q_histogram(spark, sf):
    """20-bin CLV histogram."""
    return rp.histogram(_pred(spark, sf), "clv", 20)


@q("clv_percentiles", " UNION ALL ".join(
    f"SELECT {round(p * 100)} AS percentile, quantile_cont(clv, {p}) AS value FROM pred"
    for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)), ["value"], ints=["percentile"])
def q_clv_percentiles(spark, sf):
    """CLV percentile table."""
    return rp.clv_percentiles(_pred(spark, sf))


@q("at_risk_revenue", """SELECT sum(CASE WHEN churn_probability > 0.5 THEN clv ELSE 0.0 END) AS at_risk_clv,
  sum(clv) AS total_clv, sum(CASE WHEN churn_probability > 0.5 THEN clv ELSE 0.0 END) / sum(clv) AS at_risk_share
FROM pred""", ["at_risk_clv", "total_clv", "at_risk_share"])
def q_at_risk(spark, sf):
    """CLV at risk."""
    return rp.at_risk_revenue(_pred(spark, sf))


SEG_BUDGET = """sb AS (SELECT segment, sum(allocated_budget) AS allocated_budget, sum(expected_retained) AS expected_retained,
  CASE WHEN sum(allocated_budget) > 0 THEN sum(revenue_saved) / sum(allocated_budget) ELSE 0.0 END AS roi
  FROM bm GROUP BY segment)"""


def _seg_budget(spark, sf):
    from churnlens.operators import budget as bu
    from churnlens.plans.q_budget import q_budget_allocation
    b = bu.budget_by_segment(bu.budget_metrics(q_budget_allocation(spark, sf)))
    return b.select("segment", "allocated_budget", "expected_retained", "roi")


@q("cost_per_retained", """SELECT sb.*, CASE WHEN expected_retained > 0 THEN allocated_budget / expected_retained
  ELSE 0.0 END AS cost_per_retained FROM sb""", ["allocated_budget", "expected_retained", "roi", "cost_per_retained"],
   ctes=[alloc_sql(BUDGET_SHARE), BM_SQL, SEG_BUDGET])
def q_cost_per_retained(spark, sf):
    """Cost per retained customer by segment."""
    return rp.cost_per_retained(_seg_budget(spark, sf))


@q("rescaled_budget", """SELECT sb.*, CAST(trunc(allocated_budget * 1.5) AS BIGINT) AS scaled_budget,
  round(roi * 1.2 / 1.1, 2) AS scaled_roi FROM sb""", ["allocated_budget", "expected_retained", "roi", "scaled_roi"],
   ctes=[alloc_sql(BUDGET_SHARE), BM_SQL, SEG_BUDGET])
def q_rescaled_budget(spark, sf):
    """Budget view rescaled x1.5 with uplift x1.2 and cost x1.1."""
    return rp.rescale_budget(_seg_budget(spark, sf), 1.5, 1.2, 1.1)


@q("volume_profile", """
SELECT buckets, mean, std, std / nullif(mean, 0) AS cv, buckets >= 5 AND std / nullif(mean, 0) < 0.05 AS flat_volume,
  last_24_sum, greatest(mean - std, 0.0) AS band_low, mean + std AS band_high
FROM (SELECT count(*) AS buckets, avg(requests) AS mean, stddev_samp(requests) AS std FROM h)
CROSS JOIN (SELECT sum(requests) AS last_24_sum FROM (SELECT requests FROM h ORDER BY hour DESC LIMIT 24))""",
   ["mean", "std", "cv", "band_low", "band_high"], ints=["last_24_sum"],
   ctes=["h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS requests FROM events GROUP BY 1)"])
def q_volume_profile(spark, sf):
    """Hourly event volume variation and the last 24 hours."""
    e = tb.read_table(spark, sf, "events")
    h = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("requests"))
    return rp.volume_profile(h)


@q("survival_header", """SELECT avg(CAST(event AS DOUBLE)) AS event_rate, max(duration) AS max_duration,
  median(duration) AS median_duration, median(duration) / max(duration) AS censoring_ratio FROM (
  SELECT round_even(greatest(1.0, 365 * (1 - churn_probability)), 0) AS duration, CAST(churn_probability >= 0.5 AS INTEGER) AS event
  FROM pred)""", ["event_rate", "max_duration", "median_duration", "censoring_ratio"])
def q_survival_header(spark, sf):
    """Survival header on the proxy survival frame (K8)."""
    from churnlens.operators.survival import proxy_survival
    return rp.survival_header(proxy_survival(_pred(spark, sf)))


# ---------------------------------------------------------------- O17 adapters

@register("budget_adapter", oracle("""SELECT segment, allocated_budget AS allocated_budget_krw,
  CAST(1 AS BIGINT) AS expected_retained, 0.0 AS expected_revenue_saved_krw, 0.0 AS roi FROM a3""",
    views=V, ctes=[alloc_sql(BUDGET_SHARE)],
    doubles=["allocated_budget_krw", "expected_revenue_saved_krw", "roi"]))
def q_budget_adapter(spark, sf):
    """The customer-level budget allocation mapped to the dashboard budget columns."""
    from churnlens.operators import budget as bu
    from churnlens.plans.q_budget import _budget, _scores
    s = _scores(spark, sf)
    return rp.adapt_budget(bu.allocate(s, _budget(s, BUDGET_SHARE)))


_COSTS = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in rp.DEFAULT_ACTION_COSTS.items())


@register("recommendation_adapter", oracle(f"""SELECT customer_id, action_type, score, segment, uplift_segment,
  churn_probability, uplift_score, clv, push_opt_in, email_opt_in, action_type AS recommendation_type,
  least(greatest(score, 0.0), 1.0) AS priority_score, least(greatest(uplift_score, 0.0), 1.0) AS expected_uplift,
  action_type AS recommended_offer,
  coalesce(CASE action_type {_COSTS} END, {float(rp.DEFAULT_ACTION_COST)}) AS estimated_cost
FROM recs""", views=["cust", "scores"], ctes=REC_CTES + [RA, BEST],
    doubles=["score", "churn_probability", "uplift_score", "clv", "priority_score", "expected_uplift",
             "estimated_cost"], ints=["push_opt_in", "email_opt_in"]))
def q_recommendation_adapter(spark, sf):
    """Recommendations without a cost column mapped to the dashboard columns
    (type from ``action_type``, default cost by type, priority and uplift clipped)."""
    return rp.adapt_recommendations(rc.recommend(_input(spark, sf)).drop("estimated_cost", "priority_score"))
