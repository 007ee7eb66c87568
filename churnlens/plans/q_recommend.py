"""Queries: recommendations and offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.functions.columns import risk_level_left_closed, risk_level_right_closed
from churnlens.operators import recommend as rc
from churnlens.operators import segment as sg
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.plans.q_segment import PIPE_SQL, SEGMENTS_CTE, _pipeline_segments, _rfm
from churnlens.sources import io
from churnlens.sources import tables as tb

IN_COLS = ["customer_id", "segment", "uplift_segment", "churn_probability", "uplift_score", "clv",
           "push_opt_in", "email_opt_in", "priority_score"]
IN_D = ["churn_probability", "uplift_score", "clv", "priority_score"]


def _input(spark, sf):
    s = tb.scores(spark, sf).drop("segment")
    return rc.recommend_input(s, sg.rfm_segments(_rfm(spark, sf)), _pipeline_segments(spark, sf)).select(*IN_COLS)


RIN = f"""rin AS (SELECT s.customer_id, coalesce(g.segment, 'general') AS segment,
    coalesce(p.segment, 'unknown') AS uplift_segment,
    coalesce(s.churn_probability, 0.0) AS churn_probability, coalesce(s.uplift_score, 0.0) AS uplift_score,
    coalesce(s.clv, 50000.0) AS clv, s.push_opt_in, s.email_opt_in,
    coalesce(s.uplift_score, 0.0) * coalesce(s.clv, 50000.0) AS priority_score
  FROM scores s LEFT JOIN segs g ON s.customer_id = g.customer_id
  LEFT JOIN ({PIPE_SQL}) p ON s.customer_id = p.customer_id),
rn AS (SELECT rin.*, (clv - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END AS clv_norm
  FROM rin CROSS JOIN (SELECT min(clv) AS mn, max(clv) AS mx FROM rin))"""


def _aff_sql() -> str:
    parts = []
    for name, _, _, aff in rc.ACTIONS:
        inner = "CASE segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in aff.items()) + " ELSE 1.0 END"
        parts.append(f"WHEN '{name}' THEN {inner}")
    return "CASE a.action_type " + " ".join(parts) + " END"


_S = (f"{rc.W_CHURN} * churn_probability + {rc.W_CLV} * clv_norm + {rc.W_UPLIFT} * greatest(uplift_score, 0.0) "
      f"+ {rc.W_SEGMENT} * ({_aff_sql()})")
ACTS = ", ".join(f"('{n}', {i}, {c}, {repr(ch) if ch else 'NULL'})" for i, (n, c, ch, _) in enumerate(rc.ACTIONS))
RA = f"""ra AS (SELECT r.customer_id, a.action_type, a.ord,
    round(CASE WHEN uplift_score < 0 THEN ({_S}) * greatest(0.3, 1.0 + uplift_score) ELSE ({_S}) END, 6) AS score,
    round(a.base_cost * (0.5 + clv_norm), 2) AS estimated_cost
  FROM rn r CROSS JOIN (VALUES {ACTS}) AS a(action_type, ord, base_cost, channel)
  WHERE NOT (coalesce(a.channel, '') = 'push' AND coalesce(r.push_opt_in, 1) = 0)
    AND NOT (coalesce(a.channel, '') = 'email' AND coalesce(r.email_opt_in, 1) = 0))"""
NA = """(coalesce(uplift_score, 0.0) <= 0 OR coalesce(regexp_matches(lower(segment), 'sleeping_dog|sure_thing'), false)
   OR coalesce(regexp_matches(lower(uplift_segment), 'sleeping_dog|sure_thing'), false) OR churn_probability < 0.2)"""
BEST = f"""best AS (SELECT rn.*, b.action_type AS ba, b.score AS bs, b.estimated_cost AS bc, {NA} AS na FROM rn
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, ord) AS k FROM ra)
             WHERE k = 1) b ON rn.customer_id = b.customer_id),
recs AS (SELECT customer_id, CASE WHEN na THEN 'no_action' ELSE ba END AS action_type,
    CASE WHEN na THEN 0.0 ELSE bs END AS score, CASE WHEN na THEN 0.0 ELSE bc END AS estimated_cost,
    segment, uplift_segment, churn_probability, uplift_score, clv, push_opt_in, email_opt_in, priority_score FROM best)"""
CTES = [SEGMENTS_CTE, RIN]
V = ["cust", "scores"]
REC_D = IN_D + ["score", "estimated_cost"]


@register("recommend_input", oracle("SELECT " + ", ".join(IN_COLS) + " FROM rin", views=V, ctes=CTES, doubles=IN_D,
                                    ints=["push_opt_in", "email_opt_in"]))
def q_recommend_input(spark, sf):
    """Candidate frame (scores + RFM segment + value x uplift segment)."""
    return _input(spark, sf)


@register("action_scores", oracle("SELECT customer_id, action_type, score, estimated_cost FROM ra", views=V,
                                  ctes=CTES + [RA], doubles=["score", "estimated_cost"]))
def q_action_scores(spark, sf):
    """Customer x action scores."""
    return rc.score_actions(_input(spark, sf))


@register("risk_levels", oracle("""SELECT customer_id, churn_probability,
  CASE WHEN churn_probability >= 0.75 THEN 'critical' WHEN churn_probability >= 0.5 THEN 'high'
       WHEN churn_probability >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level_left,
  CASE WHEN churn_probability <= 0.25 THEN 'low' WHEN churn_probability <= 0.5 THEN 'medium'
       WHEN churn_probability <= 0.75 THEN 'high' ELSE 'critical' END AS risk_level_right FROM scores""",
    views=["scores"], doubles=["churn_probability"]))
def q_risk_levels(spark, sf):
    """Left-closed and right-closed risk levels (they differ at .25 / .5 / .75)."""
    s = tb.scores(spark, sf)
    return s.select("customer_id", "churn_probability", risk_level_left_closed("churn_probability").alias("risk_level_left"),
                    risk_level_right_closed("churn_probability").alias("risk_level_right"))


@register("recommendations", oracle("SELECT * FROM recs", views=V, ctes=CTES + [RA, BEST], doubles=REC_D,
                                    ints=["push_opt_in", "email_opt_in"]))
def q_recommendations(spark, sf):
    """Best action per customer with the no-action policy."""
    return rc.recommend(_input(spark, sf))


@register("recommendations_top_k", oracle(f"""
SELECT customer_id, rank, action_type, score, estimated_cost FROM (
  SELECT r.customer_id, row_number() OVER (PARTITION BY r.customer_id ORDER BY r.score DESC, r.ord) AS rank,
         r.action_type, r.score, r.estimated_cost FROM ra r JOIN rn USING (customer_id) WHERE NOT {NA.replace('segment', 'rn.segment').replace('uplift_rn.segment', 'rn.uplift_segment').replace('uplift_score', 'rn.uplift_score').replace('churn_probability', 'rn.churn_probability')})
WHERE rank <= 3
UNION ALL SELECT customer_id, 1, 'no_action', 0.0, 0.0 FROM rn WHERE {NA}""", views=V, ctes=CTES + [RA],
    doubles=["score", "estimated_cost"], ints=["rank"]))
def q_recommendations_top_k(spark, sf):
    """Top-3 actions per customer; no-action customers get one row."""
    return rc.recommend_top_k(_input(spark, sf), 3)


@register("no_action_mask", oracle(f"SELECT customer_id, {NA} AS no_action FROM rn", views=V, ctes=CTES))
def q_no_action_mask(spark, sf):
    """Customers to leave alone."""
    return _input(spark, sf).select("customer_id", rc.no_action_mask().alias("no_action"))


DC = """dc0 AS (SELECT *, CASE WHEN action_type = 'no_action' THEN 0.0 ELSE greatest(uplift_score, 0.0) * clv END
    AS expected_revenue_saved FROM recs),
dc AS (SELECT *, CASE WHEN estimated_cost > 0 THEN expected_revenue_saved / estimated_cost ELSE 0.0 END AS expected_roi
  FROM dc0)"""


@register("decision_context", oracle("SELECT * FROM dc", views=V, ctes=CTES + [RA, BEST, DC],
                                     doubles=REC_D + ["expected_revenue_saved", "expected_roi"],
                                     ints=["push_opt_in", "email_opt_in"]))
def q_decision_context(spark, sf):
    """Revenue saved and expected ROI of each recommendation."""
    return rc.decision_context(rc.recommend(_input(spark, sf)))


def _reason_sql() -> str:
    fills = {"{churn}": "CAST(CAST(round_even(churn_probability * 100, 0) AS BIGINT) AS VARCHAR) || '%'",
             "{uplift}": "format('{:.2f}', round_even(uplift_score, 2))",
             "{clv}": "format('{:,}', CAST(round_even(clv, 0) AS BIGINT))", "{segment}": "coalesce(segment, 'unknown')"}
    quoted = {a: "'" + t.replace("'", "''") + "'" for a, t in rc.REASONS.items()}
    text = "CASE action_type " + " ".join(f"WHEN '{a}' THEN {t}" for a, t in quoted.items())
    text += f" ELSE '{rc.NO_ACTION_REASON}' END"
    for mark, value in fills.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


@register("recommendation_reasons", oracle(f"SELECT customer_id, action_type, {_reason_sql()} AS reason FROM recs",
                                           views=V, ctes=CTES + [RA, BEST]))
def q_reasons(spark, sf):
    """Explanation text per recommendation."""
    return rc.reason(rc.recommend(_input(spark, sf))).select("customer_id", "action_type", "reason")


OFFERS = """offers AS (SELECT customer_id, segment, risk_level, churn_probability, action_type AS recommended_action,
    ot AS offer_type, CASE WHEN action_type = 'no_action' THEN '""" + rc.OFFER_DETAILS["no_action"] + """'
      ELSE coalesce(od.detail, '""" + rc.DEFAULT_DETAIL + """') END AS offer_detail, uplift_score AS expected_uplift,
    CASE WHEN action_type = 'no_action' THEN 0.0 ELSE estimated_cost END AS estimated_cost_krw,
    up * clv AS expected_revenue_saved_krw, priority_score
  FROM (SELECT recs.*, CASE WHEN churn_probability >= 0.75 THEN 'critical' WHEN churn_probability >= 0.5 THEN 'high'
        WHEN churn_probability >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level,
      CASE WHEN action_type = 'no_action' THEN 0.0 ELSE greatest(uplift_score, 0.0) END AS up FROM recs) r0
  CROSS JOIN LATERAL (SELECT CASE
      WHEN action_type = 'coupon' AND risk_level IN ('critical', 'high') AND coalesce(segment, '') IN ('vip_loyal', 'new_customer')
        THEN 'premium_discount'
      WHEN action_type = 'coupon' THEN 'discount_coupon' WHEN action_type = 'email_campaign' THEN 'engagement_email'
      WHEN action_type IS NULL THEN 'no_action' ELSE action_type END AS ot)
  LEFT JOIN (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in rc.OFFER_DETAILS.items()) + """) AS od(ot2, detail)
    ON od.ot2 = ot)"""
OFF_D = ["churn_probability", "expected_uplift", "estimated_cost_krw", "expected_revenue_saved_krw", "priority_score"]


@register("retention_offers", oracle("SELECT * FROM offers", views=V, ctes=CTES + [RA, BEST, OFFERS], doubles=OFF_D))
def q_offers(spark, sf):
    """One retention offer per customer."""
    return rc.offers(rc.recommend(_input(spark, sf)))


@register("filter_offers", oracle("""SELECT * FROM offers WHERE risk_level IN ('critical', 'high')
  AND offer_type IN ('discount_coupon', 'premium_discount', 'personal_outreach', 'exclusive_offer')""",
    views=V, ctes=CTES + [RA, BEST, OFFERS], doubles=OFF_D))
def q_filter_offers(spark, sf):
    """Offers filtered by risk level and offer type, in priority order."""
    o = rc.offers(rc.recommend(_input(spark, sf)))
    return io.filter_offers(o, risks=["critical", "high"],
                            types=["discount_coupon", "premium_discount", "personal_outreach", "exclusive_offer"])



