"""Queries: RFM on purchases, quantile scores, rule and value segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import features as fe
from churnlens.operators import segment as sg
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.sources import tables as tb

# ---------------------------------------------------------------- shared SQL pieces

RFM_CTE = """ref AS (SELECT max(event_date) + 1 AS ref_date FROM purchases),
pagg AS (SELECT customer_id, max(event_date) AS last_purchase, count(event_date) AS frequency,
                sum(amount) AS monetary
         FROM purchases WHERE event_type = 'purchase' GROUP BY customer_id),
rfm0 AS (SELECT c.customer_id,
           CAST(greatest(coalesce(date_diff('day', a.last_purchase, r.ref_date), 365), 0) AS DOUBLE) AS recency,
           CAST(coalesce(a.frequency, 0) AS BIGINT) AS frequency,
           coalesce(a.monetary, 0.0) AS monetary
         FROM cust c LEFT JOIN pagg a ON c.customer_id = a.customer_id CROSS JOIN ref r),
rfm AS (SELECT *, CASE WHEN frequency > 0 THEN monetary / frequency ELSE 0.0 END AS avg_order_value,
          CASE WHEN recency = 366 THEN 'inf'::DOUBLE
               WHEN recency > 0 THEN monetary / (365 - recency + 1) ELSE 0.0 END AS monetary_per_day
        FROM rfm0)"""

SCORES_CTE = RFM_CTE + """,
nstat AS (SELECT count(*) AS n, count(DISTINCT recency) AS dr, count(DISTINCT frequency) AS df,
                 count(DISTINCT monetary) AS dm FROM rfm),
rk AS (SELECT rfm.*, row_number() OVER (ORDER BY recency, customer_id) AS rr,
              row_number() OVER (ORDER BY frequency, customer_id) AS rf,
              row_number() OVER (ORDER BY monetary, customer_id) AS rm FROM rfm),
scored AS (SELECT rk.* EXCLUDE (rr, rf, rm),
  CAST(CASE WHEN dr <= 1 THEN 1 ELSE 6 - greatest(1, ((rr - 1) * 5 + n - 2) // (n - 1)) END AS BIGINT) AS recency_score,
  CAST(CASE WHEN df <= 1 THEN 5 ELSE greatest(1, ((rf - 1) * 5 + n - 2) // (n - 1)) END AS BIGINT) AS frequency_score,
  CAST(CASE WHEN dm <= 1 THEN 5 ELSE greatest(1, ((rm - 1) * 5 + n - 2) // (n - 1)) END AS BIGINT) AS monetary_score
  FROM rk CROSS JOIN nstat)"""


def _rule_sql() -> str:
    names = ("recency_score", "frequency_score", "monetary_score")
    whens = []
    for name, b, *_ in sg.SEGMENT_RULES:
        conds = []
        for c, lo, hi in zip(names, b[0::2], b[1::2]):
            if lo is not None:
                conds.append(f"{c} >= {lo}")
            if hi is not None:
                conds.append(f"{c} <= {hi}")
        whens.append(f"WHEN {' AND '.join(conds)} THEN '{name}'")
    return "CASE " + " ".join(whens) + " END"


SEGMENTS_CTE = SCORES_CTE + f""",
seg0 AS (SELECT *, {_rule_sql()} AS rule_seg FROM scored),
cent AS (SELECT rule_seg AS segment, avg(recency_score) AS cr, avg(frequency_score) AS cf,
                avg(monetary_score) AS cm FROM seg0 WHERE rule_seg IS NOT NULL GROUP BY rule_seg),
near AS (SELECT s.customer_id, c.segment,
           row_number() OVER (PARTITION BY s.customer_id ORDER BY
             (s.recency_score - cr) ^ 2 + (s.frequency_score - cf) ^ 2 + (s.monetary_score - cm) ^ 2,
             c.segment) AS rn
         FROM seg0 s CROSS JOIN cent c WHERE s.rule_seg IS NULL),
segs AS (SELECT seg0.* EXCLUDE (rule_seg), coalesce(seg0.rule_seg, near.segment, 'other') AS segment
         FROM seg0 LEFT JOIN near ON seg0.customer_id = near.customer_id AND near.rn = 1)"""

RFM_D = ["recency", "monetary", "avg_order_value", "monetary_per_day"]


def _rfm(spark, sf):
    cust = tb.customers(spark, sf)
    pur = tb.purchases(spark, sf)
    return fe.rfm(cust, pur, fe.max_date_plus(pur, 1))


@register("rfm", oracle("SELECT * FROM rfm", views=["cust"], ctes=[RFM_CTE], doubles=RFM_D))
def q_rfm(spark, sf):
    """F2 on orders as purchases, reference date = last order date + 1."""
    return _rfm(spark, sf)


@register("rfm_scores", oracle("SELECT * FROM scored", views=["cust"], ctes=[SCORES_CTE], doubles=RFM_D))
def q_rfm_scores(spark, sf):
    """G1 + G2: pandas-qcut-equal quantile scores on global ranks."""
    return sg.rfm_scores(_rfm(spark, sf))


@register("rfm_segments", oracle("SELECT * FROM segs", views=["cust"], ctes=[SEGMENTS_CTE], doubles=RFM_D))
def q_rfm_segments(spark, sf):
    """G3 + G4: rule segments, nearest-centroid fallback."""
    return sg.rfm_segments(_rfm(spark, sf))


SUMMARY_SQL = oracle("""
SELECT s.segment, count(*) AS count, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       avg(monetary) AS avg_monetary, count(*) * 100.0 / (SELECT count(*) FROM segs) AS percentage,
       coalesce(m.description, '') AS description
FROM segs s LEFT JOIN (VALUES """ + ", ".join(
    "('{}', '{}')".format(r[0], r[3]) for r in sg.SEGMENT_RULES) + """) AS m(segment, description)
  ON s.segment = m.segment
GROUP BY s.segment, m.description""", views=["cust"], ctes=[SEGMENTS_CTE],
    doubles=["avg_recency", "avg_frequency", "avg_monetary", "percentage"])


@register("segment_summary", SUMMARY_SQL)
def q_segment_summary(spark, sf):
    """The flagship query -- RFM segments summarised."""
    return sg.segment_summary(sg.rfm_segments(_rfm(spark, sf)))


@register("retention_actions", oracle("""
SELECT s.segment, s.customer_id, coalesce(m.action, 'general') AS retention_action
FROM segs s LEFT JOIN (VALUES """ + ", ".join("('{}', '{}')".format(r[0], r[2]) for r in sg.SEGMENT_RULES)
    + """) AS m(segment, action) ON s.segment = m.segment""", views=["cust"], ctes=[SEGMENTS_CTE]))
def q_retention_actions(spark, sf):
    """Segment -> retention action."""
    return sg.retention_actions(sg.rfm_segments(_rfm(spark, sf)))


@register("kmeans_segments")
def q_kmeans_segments(spark, sf):
    """G5 + G6: k-means on standardised RFM, named clusters (no SQL oracle: iterative)."""
    return sg.kmeans_segments(_rfm(spark, sf)).select("customer_id", "cluster", "segment")


# ---------------------------------------------------------------- value x uplift

def _value_input(spark, sf):
    s = tb.scores(spark, sf)
    t = fe.tenure(tb.customers(spark, sf), F.to_date(F.lit("1998-08-01")))
    return s.join(t, "customer_id", "left")


Q_CLV = "(SELECT quantile_cont(clv, {p}) FROM scores)"
VALUE_SQL = oracle(f"""
SELECT s.customer_id, s.segment AS persona_segment, s.churn_probability, s.uplift_score, s.clv,
  CASE WHEN s.clv >= {Q_CLV.format(p=0.8)} THEN 'high_value' ELSE 'low_value' END AS value_tier,
  s.clv >= {Q_CLV.format(p=0.8)} AS high_value,
  s.churn_probability >= 0.5 AS high_churn,
  s.uplift_score > 0 AS positive_uplift,
  CASE WHEN s.uplift_score < 0 THEN 'sleeping_dog' WHEN abs(s.uplift_score) <= 0.05 THEN 'neutral'
       ELSE 'persuadable' END AS uplift_class,
  s.uplift_score * s.clv AS priority_score,
  t.tenure_days,
  CASE WHEN t.tenure_days <= 30 THEN 'new_customer_onboarding'
       WHEN s.uplift_score < 0 THEN 'sleeping_dog'
       WHEN abs(s.uplift_score) > 0.05 AND s.churn_probability >= 0.5 THEN
         (CASE WHEN s.clv >= {Q_CLV.format(p=0.8)} THEN 'high_value' ELSE 'low_value' END) || '_persuadable'
       WHEN s.churn_probability >= 0.5 THEN
         (CASE WHEN s.clv >= {Q_CLV.format(p=0.8)} THEN 'high_value' ELSE 'low_value' END) || '_lost_cause'
       ELSE (CASE WHEN s.clv >= {Q_CLV.format(p=0.8)} THEN 'high_value' ELSE 'low_value' END) || '_sure_thing'
  END AS segment
FROM scores s LEFT JOIN (SELECT customer_id, greatest(date_diff('day', signup_date, DATE '1998-08-01'), 0)
                         AS tenure_days FROM cust) t ON s.customer_id = t.customer_id""",
    views=["cust", "scores"], doubles=["churn_probability", "uplift_score", "clv", "priority_score"],
    ints=["tenure_days"])


@register("value_uplift_segments", VALUE_SQL)
def q_value_uplift_segments(spark, sf):
    """Two-tier value x uplift segments (onboarding <= 30 days of tenure first)."""
    df = _value_input(spark, sf).withColumnRenamed("segment", "persona_segment")
    out = sg.value_uplift_segments(df)
    return out.select("customer_id", "persona_segment", "churn_probability", "uplift_score", "clv",
                      "value_tier", "high_value", "high_churn", "positive_uplift", "uplift_class",
                      "priority_score", "tenure_days", "segment")


PIPE_SQL = oracle(f"""
SELECT customer_id, churn_probability, uplift_score, clv, value_tier, high_value, high_churn,
       positive_uplift, priority_score,
  CASE WHEN high_value AND high_churn AND uplift_score <= 0 THEN 'high_value_lost_cause'
       WHEN high_value AND NOT high_churn AND uplift_score <= 0 THEN 'high_value_sure_thing'
       WHEN uplift_score < 0 THEN 'sleeping_dog'
       WHEN high_churn AND positive_uplift THEN value_tier || '_persuadable'
       WHEN high_churn THEN value_tier || '_lost_cause'
       ELSE value_tier || '_sure_thing' END AS segment
FROM (SELECT customer_id, churn_probability, uplift_score, clv,
        CASE WHEN clv >= {Q_CLV.format(p=0.8)} THEN 'high_value'
             WHEN clv >= {Q_CLV.format(p=0.4)} THEN 'mid_value' ELSE 'low_value' END AS value_tier,
        clv >= {Q_CLV.format(p=0.8)} AS high_value, churn_probability >= 0.5 AS high_churn,
        uplift_score > 0 AS positive_uplift, uplift_score * clv AS priority_score
      FROM scores) b""", views=["scores"],
    doubles=["churn_probability", "uplift_score", "clv", "priority_score"])


def _pipeline_segments(spark, sf):
    s = tb.scores(spark, sf).select("customer_id", "churn_probability", "uplift_score", "clv")
    return sg.pipeline_value_segments(s)


@register("pipeline_value_segments", PIPE_SQL)
def q_pipeline_value_segments(spark, sf):
    """Three-tier value x uplift segments."""
    return _pipeline_segments(spark, sf)


@register("segment_evidence", oracle("""
SELECT count(*) AS total_customers, count_if(high_value) AS high_value_count,
  count_if(churn_probability >= 0.5) AS high_risk_count, count_if(uplift_score > 0) AS positive_uplift_count,
  count_if(segment = 'high_value_persuadable') AS high_value_persuadable_count,
  count_if(segment = 'high_value_lost_cause') AS high_value_lost_cause_count,
  count_if(segment IN ('high_value_persuadable', 'high_value_lost_cause')) AS high_value_actionable_count,
  count_if(high_value AND churn_probability >= 0.5 AND uplift_score > 0) AS high_value_at_risk_positive_uplift_count,
  count_if(high_value AND churn_probability >= 0.5 AND NOT uplift_score > 0)
    AS high_value_at_risk_nonpositive_uplift_count,
  CASE WHEN count_if(segment IN ('high_value_persuadable', 'high_value_lost_cause')) > 0 THEN NULL
       ELSE 'No high-value customers met persuadable or lost-cause criteria under the configured churn/uplift/CLV thresholds.'
  END AS absence_reason,
  true AS valid,
  CASE WHEN count_if(segment IN ('high_value_persuadable', 'high_value_lost_cause')) > 0
       THEN 'high_value_actionable_evidence_present' ELSE 'structured_absence_report_present' END AS validity_reason
FROM (""" + PIPE_SQL + ") p", views=[]))
def q_segment_evidence(spark, sf):
    """Evidence counts for high-value actionable segments."""
    return sg.segment_evidence(_pipeline_segments(spark, sf))


@register("segment_evidence_rows", "SELECT * FROM (" + PIPE_SQL + """) p
WHERE segment IN ('high_value_persuadable', 'high_value_lost_cause') ORDER BY priority_score DESC, customer_id LIMIT 20""")
def q_segment_evidence_rows(spark, sf):
    """The 20 actionable high-value customers of the highest priority (a top-k report)."""
    return sg.segment_evidence_samples(_pipeline_segments(spark, sf))
