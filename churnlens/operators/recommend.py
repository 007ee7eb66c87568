"""Ranked retention recommendations and offers.

The action list is a fixed table of six actions, so the scores of every action are
computed inside the customer's own row (an array of structs) and the best / top-k
actions are picked with ``array_max`` / ``sort_array`` -- no shuffle and no per-group
window. The long (customer x action) table is a broadcast cross join when needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import risk_level_left_closed
from churnlens.session import cut_lineage

# Actions in their order -- (action, base cost, channel, segment affinities).
ACTIONS = (
    ("coupon", 5000.0, None, {"bargain_hunter": 1.5, "explorer": 1.2, "dormant": 1.1, "new_customer": 1.0,
                              "regular_loyal": 0.9, "vip_loyal": 0.7}),
    ("push_notification", 100.0, "push", {"explorer": 1.3, "regular_loyal": 1.2, "bargain_hunter": 1.1,
                                          "new_customer": 1.0, "vip_loyal": 0.9, "dormant": 0.8}),
    ("email_campaign", 200.0, "email", {"regular_loyal": 1.3, "vip_loyal": 1.2, "new_customer": 1.2,
                                        "explorer": 1.0, "bargain_hunter": 0.9, "dormant": 0.8}),
    ("loyalty_points", 3000.0, None, {"vip_loyal": 1.4, "regular_loyal": 1.3, "new_customer": 1.2,
                                      "explorer": 1.0, "bargain_hunter": 0.8, "dormant": 0.7}),
    ("personal_outreach", 10000.0, None, {"new_customer": 1.5, "vip_loyal": 1.3, "dormant": 1.1,
                                          "regular_loyal": 0.8, "explorer": 0.7, "bargain_hunter": 0.6}),
    ("exclusive_offer", 8000.0, None, {"new_customer": 1.4, "vip_loyal": 1.3, "dormant": 1.2,
                                       "regular_loyal": 1.0, "bargain_hunter": 1.0, "explorer": 0.9}),
)
# Score weights (churn, CLV, uplift, segment affinity) and the low-risk skip threshold.
W_CHURN, W_CLV, W_UPLIFT, W_SEGMENT = 0.35, 0.25, 0.20, 0.20
LOW_RISK = 0.20
# Offer details per offer type.
OFFER_DETAILS = {
    "premium_discount": "30% off next 3 orders + free shipping",
    "discount_coupon": "20% off next order",
    "engagement_email": "Personalized product picks + 10% coupon",
    "loyalty_points": "2x loyalty points for 30 days",
    "personal_outreach": "Account manager personal call within 48h",
    "push_notification": "In-app push with personalized product picks",
    "email_campaign": "Targeted re-engagement email campaign",
    "exclusive_offer": "Limited-time exclusive offer for high-value tier",
    "no_action": "No intervention recommended (low ROI segment).",
}


def _with_clv_norm(df: DataFrame) -> DataFrame:
    df = cut_lineage(df)        # candidates come from several joins and are read twice
    mm = df.agg(F.min("clv").alias("__mn"), F.max("clv").alias("__mx"))
    j = df.crossJoin(F.broadcast(mm))
    rng = F.when(F.col("__mx") > F.col("__mn"), F.col("__mx") - F.col("__mn")).otherwise(1.0)
    return j.withColumn("clv_norm", (F.col("clv") - F.col("__mn")) / rng).drop("__mn", "__mx")


def _d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _action_sql(i: int, action) -> str:
    """SQL text of one action's (score, -order, type, cost) struct; null when the
    customer opted out of the action's channel. One expression string per action keeps
    plan construction to a single gateway call."""
    name, cost, channel, aff = action
    seg = "coalesce(CAST(segment AS STRING), 'unknown')"
    affinity = (f"CASE {seg} " + " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in aff.items())
                + f" ELSE {_d(1.0)} END") if aff else _d(1.0)
    base = (f"({_d(W_CHURN)} * churn_probability + {_d(W_CLV)} * clv_norm"
            f" + {_d(W_UPLIFT)} * greatest(uplift_score, {_d(0.0)}) + {_d(W_SEGMENT)} * {affinity})")
    score = (f"CASE WHEN uplift_score < 0 THEN {base} * greatest({_d(0.3)}, {_d(1.0)} + uplift_score)"
             f" ELSE {base} END")
    ok = {"push": "coalesce(push_opt_in, 1) != 0", "email": "coalesce(email_opt_in, 1) != 0"}.get(channel, "true")
    struct = (f"named_struct('score', round({score}, 6), 'neg_order', {-i}, 'action_type', '{name}',"
              f" 'estimated_cost', round({_d(cost)} * ({_d(0.5)} + clv_norm), 2))")
    return f"CASE WHEN {ok} THEN {struct} END"


def _action_array(df: DataFrame) -> DataFrame:
    arr = "array_compact(array(" + ", ".join(_action_sql(i, a) for i, a in enumerate(ACTIONS)) + "))"
    return _with_clv_norm(df).withColumn("__acts", F.expr(arr))


def no_action_mask(segment_cols=("segment", "uplift_segment")) -> Column:
    """Uplift <= 0, a segment naming sleeping_dog / sure_thing, or churn < 0.20."""
    m = F.coalesce(F.col("uplift_score"), F.lit(0.0)) <= 0
    for c in segment_cols:
        m = m | F.coalesce(F.lower(F.col(c).cast("string")).rlike("sleeping_dog|sure_thing"), F.lit(False))
    return m | (F.col("churn_probability") < LOW_RISK)


def score_actions(df: DataFrame) -> DataFrame:
    """The long (customer, action) score table (opted-out channels removed)."""
    a = _action_array(df)
    return a.select("customer_id", F.explode("__acts").alias("a")).select(
        "customer_id", "a.action_type", "a.score", "a.estimated_cost")


def recommend(df: DataFrame, segment_cols=("segment", "uplift_segment")) -> DataFrame:
    """The first highest-scoring action per customer, then the no-action policy."""
    a = _action_array(df).withColumn("__best", F.array_max("__acts"))
    na = no_action_mask([c for c in segment_cols if c in df.columns])
    return a.select(
        "customer_id",
        F.when(na, F.lit("no_action")).otherwise(F.col("__best.action_type")).alias("action_type"),
        F.when(na, F.lit(0.0)).otherwise(F.col("__best.score")).alias("score"),
        F.when(na, F.lit(0.0)).otherwise(F.col("__best.estimated_cost")).alias("estimated_cost"),
        *[c for c in df.columns if c != "customer_id"])


def recommend_top_k(df: DataFrame, k: int = 3, segment_cols=("segment", "uplift_segment")) -> DataFrame:
    """K best actions per customer; no-action customers get one no_action row."""
    na = no_action_mask([c for c in segment_cols if c in df.columns])
    a = _action_array(df).withColumn("__na", na)
    top = F.slice(F.sort_array("__acts", asc=False), 1, k)
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("neg_order"),
                            F.lit("no_action").alias("action_type"), F.lit(0.0).alias("estimated_cost")))
    e = a.select("customer_id", F.posexplode(F.when(F.col("__na"), none).otherwise(top)).alias("rank0", "x"))
    return e.select("customer_id", (F.col("rank0") + 1).alias("rank"), "x.action_type", "x.score",
                    "x.estimated_cost")


def decision_context(recs: DataFrame) -> DataFrame:
    """Revenue saved = max(uplift, 0) * clv, 0 for no action; expected ROI = saved / cost (0
    when free); the priority is the input's, else the action score."""
    saved = F.when(F.col("action_type") == "no_action", 0.0).otherwise(
        F.greatest(F.col("uplift_score"), F.lit(0.0)) * F.col("clv"))
    out = recs if "priority_score" in recs.columns else recs.withColumn("priority_score", F.col("score"))
    return (out.withColumn("expected_revenue_saved", saved)
            .withColumn("expected_roi", F.when(F.col("estimated_cost") > 0, saved / F.col("estimated_cost"))
                        .otherwise(0.0)))


def _pct(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


# Fixed sentences that must equal the reference's, by action.
REASONS = {
    "coupon": "Customer in segment '{segment}' with churn risk {churn}; coupon aligns with purchase behavior.",
    "push_notification": "Push notification selected for segment '{segment}' with engagement uplift {uplift}.",
    "email_campaign": "Email campaign for segment '{segment}' customer (CLV={clv} KRW).",
    "loyalty_points": "Loyalty points reward for '{segment}' customer to reinforce retention.",
    "personal_outreach": "High-touch outreach for '{segment}' customer with CLV={clv} KRW and churn risk {churn}.",
    "exclusive_offer": "Exclusive offer targeting '{segment}' segment with uplift score {uplift}.",
}
NO_ACTION_REASON = "No action: customer has non-positive uplift or is classified as a sleeping dog."


def reason(recs: DataFrame) -> DataFrame:
    """Explanation text from the action's sentence (half-even rounding of numbers)."""
    fills = {"segment": F.coalesce(F.col("segment").cast("string"), F.lit("unknown")),
             "churn": _pct(F.col("churn_probability")),
             "uplift": F.format_number(F.bround(F.col("uplift_score"), 2), 2),
             "clv": F.format_number(F.bround(F.col("clv"), 0), 0)}
    sentences = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    text = F.coalesce(sentences[F.col("action_type")], F.lit(NO_ACTION_REASON))
    for name, value in fills.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return recs.withColumn("reason", text)


def offer_type(action: Column, risk: Column, segment: Column) -> Column:
    hi = risk.isin("critical", "high")
    return (F.when((action == "coupon") & hi & segment.isin("vip_loyal", "new_customer"), "premium_discount")
            .when(action == "coupon", "discount_coupon")
            .when(action == "email_campaign", "engagement_email")
            .when(action.isNull(), "no_action")
            .otherwise(action))


# Fixed text that must equal the reference's.
DEFAULT_DETAIL = "Personalized retention action."


def offers(recs: DataFrame) -> DataFrame:
    """One offer row per customer from recommendations with their decision context;
    no-action rows cost and save nothing. The uplift is reported as it is; the priority is the
    context's."""
    r = recs if "expected_revenue_saved" in recs.columns else decision_context(recs)
    churn = F.least(F.greatest(F.coalesce("churn_probability", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    r = r.withColumn("segment", F.coalesce("segment", F.lit("unknown"))).withColumn("churn_probability", churn)
    risk = risk_level_left_closed("churn_probability")
    ot = offer_type(F.col("action_type"), risk, F.col("segment"))
    detail = F.create_map(*[F.lit(x) for pair in OFFER_DETAILS.items() for x in pair])
    noact = F.col("action_type") == "no_action"
    money = lambda c: F.when(noact, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return r.select(
        "customer_id", "segment", risk.alias("risk_level"), "churn_probability",
        F.col("action_type").alias("recommended_action"), ot.alias("offer_type"),
        F.when(noact, OFFER_DETAILS["no_action"]).otherwise(F.coalesce(detail[ot], F.lit(DEFAULT_DETAIL)))
        .alias("offer_detail"),
        F.coalesce("uplift_score", F.lit(0.0)).alias("expected_uplift"),
        money(F.col("estimated_cost")).alias("estimated_cost_krw"),
        money(F.col("expected_revenue_saved")).alias("expected_revenue_saved_krw"),
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"))


def recommend_input(scores: DataFrame, segments: DataFrame, uplift_segments: DataFrame,
                    predicted_clv: DataFrame | None = None) -> DataFrame:
    """Candidate frame -- scores left-joined with the RFM segment and the value x uplift
    segment. A missing segment is ``general``, a missing uplift segment ``unknown``, a missing CLV
    the predicted one or else 50000, a missing uplift or probability 0; the priority is
    uplift x CLV unless the scores have one."""
    out = (scores.join(segments.select("customer_id", "segment"), "customer_id", "left")
           .join(uplift_segments.select("customer_id", F.col("segment").alias("uplift_segment")),
                 "customer_id", "left"))
    clv = [F.col("clv"), F.lit(50000.0)]
    if predicted_clv is not None:
        out = out.join(predicted_clv.select("customer_id", "predicted_clv"), "customer_id", "left")
        clv.insert(1, F.col("predicted_clv"))
    out = (out.withColumn("segment", F.coalesce("segment", F.lit("general")))
           .withColumn("uplift_segment", F.coalesce("uplift_segment", F.lit("unknown")))
           .withColumn("churn_probability", F.coalesce("churn_probability", F.lit(0.0)))
           .withColumn("uplift_score", F.coalesce("uplift_score", F.lit(0.0)))
           .withColumn("clv", F.coalesce(*clv)).drop("predicted_clv"))
    given = [F.col("priority_score")] if "priority_score" in out.columns else []
    return out.withColumn("priority_score", F.coalesce(*given, F.col("uplift_score") * F.col("clv")))
