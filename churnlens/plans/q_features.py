"""Queries: churn label and customer features on the activity events."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.config import EVENT_CODES, EVENT_TYPES, ChurnParams
from churnlens.operators import features as fe
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.sources import tables as tb

# 30 days of events: day thresholds scaled down (parameters, not semantics)
LABEL_PARAMS = ChurnParams(no_purchase_days=10, no_login_days=20, simulation_days=30)


def sdiv(n: str, d: str, default: str | None = "0.0") -> str:
    """SQL safe ratio: zero / null denominator -> default."""
    q = f"(CASE WHEN ({d}) = 0 THEN NULL ELSE ({n}) / ({d}) END)"
    return q if default is None else f"coalesce({q}, {default})"


def _ctx(spark, sf):
    cust = tb.customers(spark, sf)
    ev = tb.activity_events(spark, sf)
    return cust, ev, fe.max_date_plus(ev, 1)


REF = "aref AS (SELECT max(event_date) + 1 AS ref_date FROM activity)"
DAILY = "daily AS (SELECT customer_id, event_date, count(*) AS n_events, " + ", ".join(
    f"count_if(event_type = '{t}') AS n_{t}" for t in EVENT_TYPES) + """,
  sum(session_duration) AS sess_sum, count(session_duration) AS sess_n,
  sum(CASE WHEN event_type = 'purchase' THEN amount END) AS purchase_amount
  FROM activity WHERE event_date IS NOT NULL GROUP BY customer_id, event_date)"""

LABEL_SQL_CTE = f"""lastd AS (SELECT customer_id,
    max(CASE WHEN event_type = 'purchase' THEN event_date END) AS last_purchase,
    max(CASE WHEN event_type IN ('page_view', 'search') THEN event_date END) AS last_login
  FROM activity GROUP BY customer_id),
lab AS (SELECT c.customer_id,
    coalesce(date_diff('day', l.last_purchase, r.ref_date), {LABEL_PARAMS.simulation_days}) AS days_since_purchase,
    coalesce(date_diff('day', l.last_login, r.ref_date), {LABEL_PARAMS.simulation_days}) AS days_since_login
  FROM cust c LEFT JOIN lastd l ON c.customer_id = l.customer_id CROSS JOIN aref r)"""


@register("churn_label", oracle(f"""
SELECT customer_id, days_since_purchase, days_since_login,
  CAST(days_since_purchase >= {LABEL_PARAMS.no_purchase_days} OR days_since_login >= {LABEL_PARAMS.no_login_days}
       AS BIGINT) AS churn_label FROM lab""", views=["cust", "activity"], ctes=[REF, LABEL_SQL_CTE],
    ints=["days_since_purchase", "days_since_login"]))
def q_churn_label(spark, sf):
    """churn label at the day after the last event (10 / 20 day thresholds)."""
    cust, ev, ref = _ctx(spark, sf)
    return fe.label_churn(cust, ev, ref, LABEL_PARAMS)


# ---------------------------------------------------------------- F3

_HALF_TYPES = ("page_view", "purchase", "add_to_cart", "coupon_use", "search", "cs_contact")
CHANGES_CTE = """span AS (SELECT customer_id, min(event_date) AS dmin, max(event_date) AS dmax FROM daily GROUP BY customer_id),
dh AS (SELECT d.*, 2 * date_diff('day', s.dmin, d.event_date) <= date_diff('day', s.dmin, s.dmax) AS first_half,
         greatest(floor(date_diff('day', s.dmin, s.dmax) / 2), 1) AS hd
       FROM daily d JOIN span s ON d.customer_id = s.customer_id),
halves AS (SELECT customer_id, any_value(hd) AS hd, """ + ", ".join(
    f"sum(CASE WHEN first_half THEN n_{t} ELSE 0 END) AS a_{t}, sum(CASE WHEN NOT first_half THEN n_{t} ELSE 0 END) AS b_{t}"
    for t in _HALF_TYPES) + """,
    sum(CASE WHEN first_half THEN sess_sum END) AS a_ss, sum(CASE WHEN first_half THEN sess_n END) AS a_sn,
    sum(CASE WHEN NOT first_half THEN sess_sum END) AS b_ss, sum(CASE WHEN NOT first_half THEN sess_n END) AS b_sn
  FROM dh GROUP BY customer_id),
chg AS (SELECT customer_id, """ + ",\n  ".join([
    sdiv("b_page_view / hd", "a_page_view / hd") + " AS visit_frequency_change",
    sdiv("b_purchase / hd", "a_purchase / hd") + " AS purchase_cycle_change",
    sdiv(sdiv("b_ss", "b_sn", None), sdiv("a_ss", "a_sn", None)) + " AS session_duration_change",
    sdiv(sdiv("b_purchase", "b_add_to_cart"), sdiv("a_purchase", "a_add_to_cart")) + " AS cart_conversion_change",
    sdiv("b_coupon_use / hd", "a_coupon_use / hd") + " AS coupon_response_change",
    sdiv("b_search / hd", "a_search / hd") + " AS search_intensity_change",
    sdiv("b_cs_contact / hd", "a_cs_contact / hd") + " AS cs_contact_change"]) + """ FROM halves),
changes AS (SELECT c.customer_id, """ + ", ".join(f"coalesce(g.{x}, 0.0) AS {x}" for x in fe.CHANGE_COLS) + """
  FROM cust c LEFT JOIN chg g ON c.customer_id = g.customer_id)"""


@register("behavior_changes", oracle("SELECT * FROM changes", views=["cust", "activity"],
                                     ctes=[DAILY, CHANGES_CTE], doubles=list(fe.CHANGE_COLS)))
def q_behavior_changes(spark, sf):
    """second-half / first-half activity ratios per customer."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.behavior_changes(cust, fe.daily_rollup(ev))


# ---------------------------------------------------------------- F4

CYCLE_CTE = """pcy AS (SELECT customer_id, sum(n_purchase) AS np, min(event_date) AS pmin, max(event_date) AS pmax
  FROM daily WHERE n_purchase > 0 GROUP BY customer_id),
cyc0 AS (SELECT c.customer_id, p.np, date_diff('day', p.pmin, p.pmax) / (p.np - 1) AS avg_cycle,
    CAST(greatest(date_diff('day', p.pmax, r.ref_date), 0) AS DOUBLE) AS since
  FROM cust c LEFT JOIN pcy p ON c.customer_id = p.customer_id CROSS JOIN aref r),
cycle AS (SELECT customer_id,
    CASE WHEN np IS NULL THEN 2.0 WHEN np = 1 THEN 1.5 ELSE greatest(""" + sdiv("since", "avg_cycle", "2.0") + """, 0.0) END
      AS purchase_cycle_anomaly,
    CASE WHEN np >= 2 THEN avg_cycle ELSE 0.0 END AS avg_purchase_cycle_days,
    CASE WHEN np >= 2 THEN since ELSE 0.0 END AS days_since_last_purchase
  FROM cyc0)"""
CYCLE_D = ["purchase_cycle_anomaly", "avg_purchase_cycle_days", "days_since_last_purchase"]


@register("purchase_cycle", oracle("SELECT * FROM cycle", views=["cust", "activity"],
                                   ctes=[REF, DAILY, CYCLE_CTE], doubles=CYCLE_D))
def q_purchase_cycle(spark, sf):
    """purchase-cycle anomaly."""
    cust, ev, ref = _ctx(spark, sf)
    return fe.purchase_cycle(cust, fe.daily_rollup(ev), ref)


# ---------------------------------------------------------------- F5, F6, F7

TOT_CTE = "tot AS (SELECT customer_id, sum(n_events) AS n_events, count(*) AS visit_days, min(event_date) AS dmin, " \
    "max(event_date) AS dmax, sum(sess_sum) AS sess_sum, sum(sess_n) AS sess_n, " + ", ".join(
        f"sum(n_{t}) AS n_{t}" for t in EVENT_TYPES) + " FROM daily GROUP BY customer_id)"
SESSION_COLS = ["avg_session_duration", "pageviews_per_session", "search_to_purchase_rate",
                "cart_abandonment_rate", "avg_events_per_day"]
SESSION_CTE = TOT_CTE + """,
sq0 AS (SELECT customer_id,
   coalesce(""" + sdiv("sess_sum", "sess_n", None) + """, n_events / greatest(visit_days, 1)) AS avg_session_duration,
   n_page_view / greatest(visit_days, 1) AS pageviews_per_session,
   """ + sdiv("n_purchase", "n_search") + """ AS search_to_purchase_rate,
   """ + sdiv("n_remove_from_cart", "n_add_to_cart") + """ AS cart_abandonment_rate,
   n_events / greatest(date_diff('day', dmin, dmax) + 1, 1) AS avg_events_per_day FROM tot),
session AS (SELECT c.customer_id, """ + ", ".join(f"coalesce(s.{x}, 0.0) AS {x}" for x in SESSION_COLS) + """
  FROM cust c LEFT JOIN sq0 s ON c.customer_id = s.customer_id)"""


@register("session_quality", oracle("SELECT * FROM session", views=["cust", "activity"],
                                    ctes=[DAILY, SESSION_CTE], doubles=SESSION_COLS))
def q_session_quality(spark, sf):
    """session quality features."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.session_quality(cust, fe.daily_rollup(ev))


@register("event_counts", oracle("SELECT customer_id, " + ", ".join(f"n_{t} AS {t}" for t in EVENT_TYPES)
                                 + " FROM tot", views=["activity"], ctes=[DAILY, TOT_CTE], ints=list(EVENT_TYPES)))
def q_event_counts(spark, sf):
    """customer x event-type count matrix."""
    _, ev, _ = _ctx(spark, sf)
    return fe.event_counts(fe.daily_rollup(ev))


SEQSTAT_CTE = TOT_CTE.replace("tot AS", "tot2 AS") + """,
seqstat AS (SELECT c.customer_id,
   CAST(coalesce(""" + " + ".join(f"(CASE WHEN n_{t} > 0 THEN 1 ELSE 0 END)" for t in EVENT_TYPES) + """, 0) AS BIGINT)
     AS sequence_diversity,
   CAST(coalesce(""" + " + ".join(f"n_{t}" for t in EVENT_TYPES) + """, 0) AS BIGINT) AS sequence_length
  FROM cust c LEFT JOIN tot2 t ON c.customer_id = t.customer_id)"""


@register("sequence_stats", oracle("SELECT * FROM seqstat", views=["cust", "activity"], ctes=[DAILY, SEQSTAT_CTE]))
def q_sequence_stats(spark, sf):
    """event-type diversity and sequence length."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.sequence_stats(cust, fe.daily_rollup(ev))


# ---------------------------------------------------------------- F8, F9

TREND_CTE = """pidx AS (SELECT customer_id, coalesce(amount, 0.0) AS amount,
    row_number() OVER (PARTITION BY customer_id ORDER BY event_date, event_id) AS idx
  FROM activity WHERE event_type = 'purchase'),
ptr AS (SELECT customer_id, count(*) AS n, stddev_pop(amount) AS sd, corr(CAST(idx AS DOUBLE), amount) AS r
  FROM pidx GROUP BY customer_id),
trend AS (SELECT c.customer_id,
    CASE WHEN p.n IS NULL OR p.n < 2 OR p.sd = 0 OR p.r IS NULL OR isnan(p.r) THEN 0.0 ELSE p.r END
      AS purchase_sequence_trend
  FROM cust c LEFT JOIN ptr p ON c.customer_id = p.customer_id)"""


@register("purchase_trend", oracle("SELECT * FROM trend", views=["cust", "activity"], ctes=[TREND_CTE],
                                   doubles=["purchase_sequence_trend"]))
def q_purchase_trend(spark, sf):
    """F8: Pearson correlation of purchase order and amount."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.purchase_trend(cust, ev)


@register("behavior_cluster")
def q_behavior_cluster(spark, sf):
    """k-means cluster of the event-type share vector (no SQL oracle: iterative)."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.behavior_cluster(cust, fe.daily_rollup(ev))


# ---------------------------------------------------------------- F10

TIME_COLS = ["weekend_purchase_ratio", "evening_activity_ratio", "morning_activity_ratio",
             "night_activity_ratio", "day_variance"]
TIME_CTE = """hourly AS (SELECT customer_id, hour("timestamp") AS hour, count(*) AS cnt FROM activity
  WHERE "timestamp" IS NOT NULL GROUP BY customer_id, hour("timestamp")),
hp AS (SELECT customer_id,
    sum(CASE WHEN hour >= 6 AND hour < 12 THEN cnt ELSE 0 END) / sum(cnt) AS morning_activity_ratio,
    sum(CASE WHEN hour >= 18 AND hour < 22 THEN cnt ELSE 0 END) / sum(cnt) AS evening_activity_ratio,
    sum(CASE WHEN hour >= 22 OR hour < 6 THEN cnt ELSE 0 END) / sum(cnt) AS night_activity_ratio,
    arg_max(hour, cnt * 100 - hour) AS peak_hour FROM hourly GROUP BY customer_id),
dp AS (SELECT customer_id,
    """ + sdiv("sum(CASE WHEN isodow(event_date) >= 6 THEN n_purchase ELSE 0 END)", "sum(n_purchase)", None) + """
      AS weekend_purchase_ratio,
    var_samp(n_events) AS day_variance FROM daily GROUP BY customer_id),
timef AS (SELECT c.customer_id, coalesce(dp.weekend_purchase_ratio, 0.0) AS weekend_purchase_ratio,
    coalesce(hp.evening_activity_ratio, 0.0) AS evening_activity_ratio,
    coalesce(hp.morning_activity_ratio, 0.0) AS morning_activity_ratio,
    coalesce(hp.night_activity_ratio, 0.0) AS night_activity_ratio,
    CAST(coalesce(hp.peak_hour, 12) AS BIGINT) AS peak_hour, coalesce(dp.day_variance, 0.0) AS day_variance
  FROM cust c LEFT JOIN dp ON c.customer_id = dp.customer_id LEFT JOIN hp ON c.customer_id = hp.customer_id)"""


@register("time_features", oracle("SELECT * FROM timef", views=["cust", "activity"], ctes=[DAILY, TIME_CTE],
                                  doubles=TIME_COLS))
def q_time_features(spark, sf):
    """time-of-day / week features."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.time_features(cust, fe.daily_rollup(ev), fe.hourly_profile(ev))


# ---------------------------------------------------------------- F11, F12

JOURNEY_CTE = """jspan AS (SELECT customer_id, min(event_date) AS dmin, max(event_date) AS dmax FROM daily GROUP BY customer_id),
jg AS (SELECT d.customer_id, any_value(greatest(date_diff('day', s.dmin, s.dmax), 0)) AS span,
    sum(n_events) AS cnt, sum(CASE WHEN d.event_date > s.dmax - 30 THEN n_events ELSE 0 END) AS rc,
    sum(n_purchase) AS pc
  FROM daily d JOIN jspan s ON d.customer_id = s.customer_id GROUP BY d.customer_id),
jr AS (SELECT *, rc / 30.0 AS rr,
    CASE WHEN span > 30 THEN (cnt - rc) / greatest(span - 30, 1) ELSE rc / 30.0 END AS older FROM jg),
jf AS (SELECT *, span < 30 AS onb FROM jr),
jf2 AS (SELECT *, NOT onb AND rr > older * 1.2 AS grow FROM jf),
jf3 AS (SELECT *, NOT onb AND NOT grow AND rr > older * 0.8 AND pc >= 3 AS mat FROM jf2),
jf4 AS (SELECT *, NOT onb AND NOT grow AND NOT mat AND rr < older * 0.5 AS dec FROM jf3),
jf5 AS (SELECT *, NOT (onb OR grow OR mat OR dec) AS rem FROM jf4),
jf6 AS (SELECT *, rem AND rr < 0.1 AS dorm FROM jf5),
jst AS (SELECT customer_id,
    CASE WHEN onb OR (rem AND NOT dorm AND pc < 2) THEN 0 WHEN grow THEN 1 WHEN mat THEN 2 WHEN dec THEN 3
         WHEN dorm THEN 4 ELSE 2 END AS journey_stage,
    greatest(CASE WHEN grow THEN least(30, span) WHEN dec OR dorm THEN 30 ELSE span END, 0) AS stage_tenure_days
  FROM jf6),
journey AS (SELECT c.customer_id, CAST(coalesce(j.journey_stage, 4) AS BIGINT) AS journey_stage,
    CAST(coalesce(j.stage_tenure_days, 0) AS BIGINT) AS stage_tenure_days
  FROM cust c LEFT JOIN jst j ON c.customer_id = j.customer_id)"""


@register("journey_stage", oracle("SELECT * FROM journey", views=["cust", "activity"], ctes=[DAILY, JOURNEY_CTE]))
def q_journey_stage(spark, sf):
    """journey stage and stage tenure."""
    cust, ev, _ = _ctx(spark, sf)
    return fe.journey_stage(cust, fe.daily_rollup(ev))


TENURE_CTE = """ten AS (SELECT c.customer_id, greatest(date_diff('day', c.signup_date, r.ref_date), 0) AS tenure_days
  FROM cust c CROSS JOIN aref r)"""


@register("tenure", oracle("SELECT * FROM ten", views=["cust", "activity"], ctes=[REF, TENURE_CTE],
                           ints=["tenure_days"]))
def q_tenure(spark, sf):
    """tenure in days at the reference date."""
    cust, ev, ref = _ctx(spark, sf)
    return fe.tenure(cust, ref)


# ---------------------------------------------------------------- F13 + Q6

FEATURE_COLS_RFM = ["recency", "frequency", "monetary", "avg_order_value", "monetary_per_day"]
ARFM_CTE = """apagg AS (SELECT customer_id, max(event_date) AS last_purchase, count(event_date) AS frequency,
    sum(amount) AS monetary FROM activity WHERE event_type = 'purchase' GROUP BY customer_id),
arfm0 AS (SELECT c.customer_id,
    CAST(greatest(coalesce(date_diff('day', a.last_purchase, r.ref_date), 365), 0) AS DOUBLE) AS recency,
    CAST(coalesce(a.frequency, 0) AS BIGINT) AS frequency, coalesce(a.monetary, 0.0) AS monetary
  FROM cust c LEFT JOIN apagg a ON c.customer_id = a.customer_id CROSS JOIN aref r),
arfm AS (SELECT *, CASE WHEN frequency > 0 THEN monetary / frequency ELSE 0.0 END AS avg_order_value,
    CASE WHEN recency = 366 THEN 'inf'::DOUBLE WHEN recency > 0 THEN monetary / (365 - recency + 1) ELSE 0.0 END
      AS monetary_per_day FROM arfm0)"""

MATRIX_FEATURES = (FEATURE_COLS_RFM + list(fe.CHANGE_COLS) + CYCLE_D + SESSION_COLS
                   + ["sequence_diversity", "sequence_length", "purchase_sequence_trend"]
                   + ["weekend_purchase_ratio", "evening_activity_ratio", "morning_activity_ratio",
                      "night_activity_ratio", "peak_hour", "day_variance"]
                   + ["journey_stage", "stage_tenure_days", "tenure_days"])
CLIPPED = [c for c in MATRIX_FEATURES if c not in fe.SANITIZE_EXCLUDE]


def _matrix_sql() -> str:
    raw_sel = ", ".join(
        [f"c.customer_id, c.persona, c.churn_label, c.treatment_group, c.signup_date"]
        + [f"arfm.{x}" for x in FEATURE_COLS_RFM] + [f"changes.{x}" for x in fe.CHANGE_COLS]
        + [f"cycle.{x}" for x in CYCLE_D] + [f"session.{x}" for x in SESSION_COLS]
        + ["seqstat.sequence_diversity", "seqstat.sequence_length", "trend.purchase_sequence_trend"]
        + [f"timef.{x}" for x in ["weekend_purchase_ratio", "evening_activity_ratio", "morning_activity_ratio",
                                   "night_activity_ratio", "peak_hour", "day_variance"]]
        + ["journey.journey_stage", "journey.stage_tenure_days", "ten.tenure_days"])
    joins = " ".join(f"LEFT JOIN {t} ON c.customer_id = {t}.customer_id"
                     for t in ["arfm", "changes", "cycle", "session", "seqstat", "trend", "timef", "journey", "ten"])
    clean = ", ".join(
        f"CASE WHEN {x} IS NULL OR isnan(CAST({x} AS DOUBLE)) OR isinf(CAST({x} AS DOUBLE)) THEN 0.0 "
        f"ELSE CAST({x} AS DOUBLE) END AS {x}" for x in CLIPPED)
    stats = ", ".join(f"quantile_cont({x}, 0.01) AS lo_{x}, quantile_cont({x}, 0.99) AS hi_{x}, "
                      f"count(DISTINCT {x}) AS nd_{x}" for x in CLIPPED)
    out = ", ".join(f"CASE WHEN nd_{x} <= 2 OR NOT (lo_{x} < hi_{x}) THEN {x} "
                    f"ELSE least(greatest({x}, lo_{x}), hi_{x}) END AS {x}" for x in CLIPPED)
    keep = [x for x in MATRIX_FEATURES if x not in CLIPPED]
    return f"""raw AS (SELECT {raw_sel} FROM cust c {joins}),
cleaned AS (SELECT customer_id, persona, churn_label, treatment_group, signup_date, {', '.join(keep)}, {clean} FROM raw),
qstat AS (SELECT {stats} FROM cleaned),
matrix AS (SELECT customer_id, persona, churn_label, treatment_group, signup_date, {', '.join(keep)}, {out}
  FROM cleaned CROSS JOIN qstat)"""


MATRIX_SQL = oracle("SELECT * FROM matrix", views=["cust", "activity"],
                    ctes=[REF, DAILY, ARFM_CTE, CHANGES_CTE, CYCLE_CTE, SESSION_CTE, SEQSTAT_CTE, TREND_CTE,
                          TIME_CTE, JOURNEY_CTE, TENURE_CTE, _matrix_sql()],
                    doubles=CLIPPED, ints=["churn_label", "peak_hour", "journey_stage"])


@register("feature_matrix", MATRIX_SQL)
def q_feature_matrix(spark, sf):
    """F13 + Q6: all features joined and sanitised (the k-means cluster is query behavior_cluster)."""
    cust, ev, ref = _ctx(spark, sf)
    return fe.build_features(cust, ev, ref, with_cluster=False)


# ---------------------------------------------------------------- F14-F18

PANEL_COLS = ["event_count", "purchase_count", "page_view_count", "search_count", "cart_count", "coupon_count"]
PANEL_CTE = """panel AS (SELECT customer_id, CAST(date_trunc('month', event_date) AS DATE) AS month,
    count(*) AS event_count, count_if(event_type = 'purchase') AS purchase_count,
    count_if(event_type = 'page_view') AS page_view_count, count_if(event_type = 'search') AS search_count,
    count_if(event_type IN ('add_to_cart', 'remove_from_cart')) AS cart_count,
    count_if(event_type = 'coupon_use') AS coupon_count, coalesce(sum(amount), 0.0) AS amount
  FROM activity GROUP BY customer_id, CAST(date_trunc('month', event_date) AS DATE))"""


@register("monthly_panel", oracle("""SELECT p.*, coalesce(t.tenure_days, 0) AS tenure_days
  FROM panel p LEFT JOIN ten t ON p.customer_id = t.customer_id""",
    views=["cust", "activity"], ctes=[REF, PANEL_CTE, TENURE_CTE], doubles=["amount"], ints=["tenure_days"]))
def q_monthly_panel(spark, sf):
    """monthly customer panel joined with a static feature (tenure)."""
    cust, ev, ref = _ctx(spark, sf)
    return fe.monthly_panel(ev, fe.tenure(cust, ref))


CODE_CASE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in EVENT_CODES.items()) + " ELSE 0 END"


@register("event_sequences", oracle(f"""
SELECT customer_id, list_concat(list_resize([]::INTEGER[], 50 - len(codes), 0), codes) AS sequence
FROM (SELECT customer_id, list(code ORDER BY "timestamp", event_id) AS codes
      FROM (SELECT customer_id, "timestamp", event_id, CAST({CODE_CASE} AS INTEGER) AS code,
              row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, event_id DESC) AS rn
            FROM activity) WHERE rn <= 50 GROUP BY customer_id)""", views=["activity"]))
def q_event_sequences(spark, sf):
    """last 50 event codes per customer, left-padded with 0."""
    _, ev, _ = _ctx(spark, sf)
    return fe.event_sequences(ev, 50)


def _weekly_panel(ev):
    """Weekly panel: 30 days of events give at most 5 weeks (the windowed sequences need > 1 step)."""
    et = F.col("event_type")
    return ev.groupBy("customer_id", F.date_trunc("week", "event_date").cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(et == "purchase").alias("purchase_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))


SEQ_FEATURES = ["event_count", "purchase_count", "amount"]
WEEKLY_CTE = """wpanel AS (SELECT customer_id, CAST(date_trunc('week', event_date) AS DATE) AS month,
    count(*) AS event_count, count_if(event_type = 'purchase') AS purchase_count, coalesce(sum(amount), 0.0) AS amount
  FROM activity GROUP BY customer_id, CAST(date_trunc('week', event_date) AS DATE)),
wseq AS (SELECT p.customer_id, l.churn_label,
    list([CAST(event_count AS DOUBLE), CAST(purchase_count AS DOUBLE), amount] ORDER BY month) AS steps
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month DESC) AS rn FROM wpanel) p
  JOIN lab2 l ON p.customer_id = l.customer_id WHERE rn <= 4 GROUP BY p.customer_id, l.churn_label),
fseq AS (SELECT customer_id, churn_label,
    list_concat(list_resize([]::DOUBLE[][], 4 - len(steps), [0.0, 0.0, 0.0]), steps) AS sequence FROM wseq)"""
LAB2 = f"""lab2 AS (SELECT customer_id, CAST(days_since_purchase >= {LABEL_PARAMS.no_purchase_days}
    OR days_since_login >= {LABEL_PARAMS.no_login_days} AS INTEGER) AS churn_label FROM lab)"""


def _feature_sequences(spark, sf):
    cust, ev, ref = _ctx(spark, sf)
    labels = fe.label_churn(cust, ev, ref, LABEL_PARAMS)
    return fe.feature_sequences(_weekly_panel(ev), labels, SEQ_FEATURES, 4)


@register("feature_sequences", oracle("""SELECT customer_id, churn_label,
  list_transform(sequence, lambda s: list_transform(s, lambda x: (round(x, 6) + 0.0))) AS sequence FROM fseq""",
    views=["cust", "activity"], ctes=[REF, LABEL_SQL_CTE, LAB2, WEEKLY_CTE], ints=["churn_label"]))
def q_feature_sequences(spark, sf):
    """F16: last 4 weekly feature vectors of labelled customers, left zero-padded."""
    return _feature_sequences(spark, sf)


@register("scaled_sequences", oracle("""
SELECT customer_id, churn_label, list_transform(sequence, lambda s:     CASE WHEN list_bool_and(list_transform(s, lambda x: x = 0.0)) THEN s
         ELSE list_transform(s, lambda x, i: (round((x - mu[i]) / sd[i], 6) + 0.0)) END) AS sequence
FROM fseq CROSS JOIN (
  SELECT [avg(v[1]), avg(v[2]), avg(v[3])] AS mu,
         [stddev_pop(v[1]) + 1e-8, stddev_pop(v[2]) + 1e-8, stddev_pop(v[3]) + 1e-8] AS sd
  FROM (SELECT unnest(sequence) AS v FROM fseq))""",
    views=["cust", "activity"], ctes=[REF, LABEL_SQL_CTE, LAB2, WEEKLY_CTE], ints=["churn_label"]))
def q_scaled_sequences(spark, sf):
    """sequences standardised per feature over all steps; padding stays 0."""
    return fe.scale_sequences(_feature_sequences(spark, sf), len(SEQ_FEATURES))


PSEUDO_COLS = ["recency", "frequency", "monetary"]


@register("pseudo_sequences", oracle("""
SELECT customer_id, [list_transform(z, lambda x: (round(x * 1 / 3, 6) + 0.0)), list_transform(z, lambda x: (round(x * 2 / 3, 6) + 0.0)),
                     list_transform(z, lambda x: (round(x * 3 / 3, 6) + 0.0))] AS sequence
FROM (SELECT customer_id, [(recency - mr) / (sr + 1e-8), (frequency - mf) / (sf + 1e-8), (monetary - mm) / (sm + 1e-8)] AS z
      FROM arfm CROSS JOIN (SELECT avg(recency) AS mr, stddev_pop(recency) AS sr, avg(frequency) AS mf,
                                   stddev_pop(frequency) AS sf, avg(monetary) AS mm, stddev_pop(monetary) AS sm FROM arfm))""",
    views=["cust", "activity"], ctes=[REF, ARFM_CTE]))
def q_pseudo_sequences(spark, sf):
    """tabular pseudo-sequences (3 steps) of the activity RFM features."""
    cust, ev, ref = _ctx(spark, sf)
    return fe.pseudo_sequences(fe.rfm(cust, ev, ref), PSEUDO_COLS, 3)


@register("last_shipment", oracle("""SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS order_date,
  s.ship_date, s.n_lines, s.value
FROM orders o ASOF LEFT JOIN (SELECT o_custkey, CAST(l_shipdate AS DATE) AS ship_date, count(*) AS n_lines, sum(l_extendedprice) AS value
                              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) s
  ON o.o_custkey = s.o_custkey AND CAST(o.o_orderdate AS DATE) >= s.ship_date""", views=[], doubles=["value"]))
def q_last_shipment(spark, sf):
    """Point-in-time feature: what a customer was last sent on or before the date of each order (as-of merge)."""
    from churnlens.functions.asof import asof
    orders = tb.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"))
    sent = tb.read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.to_date("l_shipdate").alias("ship_date"),
                                                       "l_extendedprice")
    sent = sent.join(orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id", "ship_date").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("value"))
    return asof(orders, sent, "order_date", "ship_date", ["n_lines", "value"], by=["customer_id"])
