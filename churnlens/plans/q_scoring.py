"""Queries: request scoring, streaming and throughput."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlens.functions.columns import safe_div
from churnlens.operators import features as fe
from churnlens.operators import scoring as scr
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.plans.q_features import DAILY, LABEL_PARAMS, LABEL_SQL_CTE, REF, TOT_CTE, sdiv
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources import tables as tb
from churnlens.streaming import scorer as st
from churnlens.streaming import state as ss

NP, NL = LABEL_PARAMS.no_purchase_days, LABEL_PARAMS.no_login_days
V = ["cust", "activity"]
FEAT_D = ["recency", "monetary", "avg_order_value", "days_since_last_purchase", "days_since_last_login",
          "avg_session_duration", "coupon_usage_rate", "cart_abandonment_rate", "preferred_category_encoded",
          "segment_encoded"]
FEAT_I = ["frequency", "total_purchases", "session_count_30d", "review_count", "cs_contact_count"]


def _features(spark, sf):
    """Scoring features of every customer with activity, plus the time of the last event."""
    cust, ev = tb.customers(spark, sf), tb.activity_events(spark, sf)
    ref = fe.max_date_plus(ev, 1)
    lab = fe.label_churn(cust, ev, ref, LABEL_PARAMS)
    stats = fe.customer_stats(fe.daily_rollup(ev))
    last_ts = ev.groupBy("customer_id").agg(F.max("timestamp").alias("timestamp"))
    n = lambda t: F.col(f"n_{t}")
    j = stats.join(lab, "customer_id").join(last_ts, "customer_id")
    return j.select(
        "customer_id", F.col("days_since_purchase").cast("double").alias("recency"),
        n("purchase").alias("frequency"), F.coalesce("p_amount", F.lit(0.0)).alias("monetary"),
        safe_div(F.coalesce("p_amount", F.lit(0.0)), n("purchase")).alias("avg_order_value"),
        F.col("days_since_purchase").cast("double").alias("days_since_last_purchase"),
        F.col("days_since_login").cast("double").alias("days_since_last_login"),
        n("purchase").alias("total_purchases"), F.col("visit_days").alias("session_count_30d"),
        safe_div("sess_sum", "sess_n").alias("avg_session_duration"),
        safe_div(n("coupon_use"), "n_events").alias("coupon_usage_rate"),
        safe_div(n("remove_from_cart"), n("add_to_cart")).alias("cart_abandonment_rate"),
        n("review").alias("review_count"), n("cs_contact").alias("cs_contact_count"),
        F.lit(0.0).alias("preferred_category_encoded"), F.lit(0.0).alias("segment_encoded"), "timestamp")


FEAT_CTE = """lastts AS (SELECT customer_id, max("timestamp") AS ts FROM activity GROUP BY customer_id),
feat AS (SELECT t.customer_id, CAST(l.days_since_purchase AS DOUBLE) AS recency, t.n_purchase AS frequency,
    coalesce(p.pa, 0.0) AS monetary, """ + sdiv("coalesce(p.pa, 0.0)", "t.n_purchase") + """ AS avg_order_value,
    CAST(l.days_since_purchase AS DOUBLE) AS days_since_last_purchase,
    CAST(l.days_since_login AS DOUBLE) AS days_since_last_login, t.n_purchase AS total_purchases,
    t.visit_days AS session_count_30d, """ + sdiv("t.sess_sum", "t.sess_n") + """ AS avg_session_duration,
    """ + sdiv("t.n_coupon_use", "t.n_events") + """ AS coupon_usage_rate,
    """ + sdiv("t.n_remove_from_cart", "t.n_add_to_cart") + """ AS cart_abandonment_rate,
    t.n_review AS review_count, t.n_cs_contact AS cs_contact_count, 0.0 AS preferred_category_encoded,
    0.0 AS segment_encoded, lt.ts AS "timestamp"
  FROM tot t JOIN lab l ON t.customer_id = l.customer_id JOIN lastts lt ON t.customer_id = lt.customer_id
  LEFT JOIN (SELECT customer_id, sum(purchase_amount) AS pa FROM daily GROUP BY customer_id) p
    ON t.customer_id = p.customer_id)"""
CTES = [REF, DAILY, TOT_CTE, LABEL_SQL_CTE, FEAT_CTE]


def heur_sql(prefix: str = "") -> str:
    def num(c, d):
        return f"(CASE WHEN {prefix}{c} IS NULL OR {prefix}{c} = 0 THEN {d} ELSE CAST({prefix}{c} AS DOUBLE) END)"
    raw = (f"least(coalesce(CAST({prefix}days_since_last_purchase AS DOUBLE), 0.0) / {NP}, 2.0) * 0.3 "
           f"+ least(coalesce(CAST({prefix}days_since_last_login AS DOUBLE), 0.0) / {NL}, 2.0) * 0.2 "
           f"+ greatest(0.0, 1.0 - {num('frequency', 5.0)} / 10.0) * 0.2 "
           f"+ greatest(0.0, 1.0 - {num('session_count_30d', 10.0)} / 20.0) * 0.15 "
           f"+ least({num('cart_abandonment_rate', 0.2)}, 1.0) * 0.15")
    return f"least(greatest({raw}, 0.0), 1.0)"


RISK = """CASE WHEN p >= 0.75 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.25 THEN 'medium' ELSE 'low' END"""
ACT = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scr.RISK_ACTIONS.items()) + " END"


@register("scoring_features", oracle("SELECT * FROM feat", views=V, ctes=CTES, doubles=FEAT_D, ints=FEAT_I))
def q_scoring_features(spark, sf):
    """Scoring feature rows (the request payload) of customers with activity."""
    return _features(spark, sf)


@register("validate_features", oracle("""SELECT customer_id, list_concat(['Missing required feature: review_count'],
    CASE WHEN customer_id % 3 = 0 THEN []::VARCHAR[] ELSE ['Feature ''segment_encoded'' must be numeric, got str'] END)
    AS errors, false AS valid FROM feat
  UNION ALL SELECT customer_id, []::VARCHAR[], true FROM feat""", views=V, ctes=CTES))
def q_validate(spark, sf):
    """Feature validation of rows without a required column and with text (or null) as a
    feature, and of complete rows."""
    f = _features(spark, sf)
    text = F.when(F.col("customer_id") % 3 != 0, F.lit("vip"))
    bad = f.drop("review_count").withColumn("segment_encoded", text)
    out = scr.validate_features(bad).select("customer_id", "errors", "valid")
    return out.unionByName(scr.validate_features(f).select("customer_id", "errors", "valid"))


SCORED = f"""scored AS (SELECT customer_id, p AS churn_probability, {RISK} AS risk_level FROM (
  SELECT customer_id, {heur_sql()} AS p FROM feat))"""


@register("batch_scores", oracle(f"SELECT customer_id, churn_probability, risk_level, {ACT} AS recommended_action, "
                                 "'heuristic' AS model_type FROM scored", views=V, ctes=CTES + [SCORED],
                                 doubles=["churn_probability"]))
def q_batch_scores(spark, sf):
    """T2 + T3: heuristic churn score, risk level and action per customer."""
    return scr.score_batch(_features(spark, sf), NP, NL).select(
        "customer_id", "churn_probability", "risk_level", "recommended_action", "model_type")


def _scratch(spark, name: str) -> str:
    """A folder of this call below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _requests(spark, sf) -> str:
    f = _features(spark, sf).withColumn("message_id", F.col("customer_id"))
    return st.write_requests(f, _scratch(spark, "requests"))


@register("parsed_requests", oracle("""SELECT CAST(customer_id AS VARCHAR) AS message_id,
  CAST(customer_id AS VARCHAR) AS customer_id, 'score' AS request_type, """ + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in scr.NUMERIC_FEATURES) + " FROM feat", views=V, ctes=CTES,
    doubles=list(scr.NUMERIC_FEATURES)))
def q_parsed_requests(spark, sf):
    """T5 + T4: requests written with JSON features, read back and parsed (batch read)."""
    path = _requests(spark, sf)
    raw = spark.read.schema(st.REQUEST_SCHEMA).parquet(path)
    return st.parse_requests(raw).select("message_id", "customer_id", "request_type", *scr.NUMERIC_FEATURES)


STREAM_SQL = oracle(f"""SELECT CAST(f.customer_id AS VARCHAR) AS customer_id, s.churn_probability, s.risk_level,
  {ACT.replace('risk_level', 's.risk_level')} AS recommended_action, 'heuristic' AS model_type,
  strftime(f."timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS scored_at, CAST(f.customer_id AS VARCHAR) AS request_message_id
FROM feat f JOIN scored s ON f.customer_id = s.customer_id""", views=V, ctes=CTES + [SCORED],
    doubles=["churn_probability"])


@register("stream_scores", STREAM_SQL)
def q_stream_scores(spark, sf):
    """T6 + T7 + T8: Structured Streaming scorer drained with availableNow (dedup by message
    id within the watermark, foreachBatch into an idempotent Parquet sink)."""
    src = _requests(spark, sf)
    sink, ck = _scratch(spark, "stream-sink"), _scratch(spark, "stream-checkpoint")
    st.score_stream(spark, src, sink, ck, once=True, no_purchase_days=NP, no_login_days=NL)
    return spark.read.parquet(sink).select(*st.RESPONSE_COLUMNS)


END_TS = "2024-02-01 00:00:00"
N_HISTORY = 100
HIST = f"""hist AS (SELECT make_timestamp(CAST(floor(epoch(TIMESTAMP '{END_TS}') - 86400.0 + (i - 1) * 86400.0
      / greatest(n - 1, 1)) AS BIGINT) * 1000000) AS "timestamp", *  FROM (
  SELECT *, count(*) OVER () AS n FROM (
    SELECT customer_id, churn_probability, segment, clv, row_number() OVER (ORDER BY md5('42:' || customer_id), customer_id)
      AS i FROM scores) WHERE i <= {N_HISTORY}))"""
RISK_RIGHT = """CASE WHEN churn_probability <= 0.25 THEN 'low' WHEN churn_probability <= 0.5 THEN 'medium'
  WHEN churn_probability <= 0.75 THEN 'high' ELSE 'critical' END"""


@register("scoring_history", oracle(f"""SELECT "timestamp", "timestamp" AS scored_at, CAST(customer_id AS VARCHAR) AS customer_id,
  churn_probability, {RISK_RIGHT} AS risk_level, 'ensemble_v1' AS model_version, 'ensemble_v1' AS model_type,
  round(18.0 + churn_probability * 12.0 + ((i - 1) % 7) * 0.35, 2) AS latency_ms, false AS scoring_error, segment,
  floor(clv) AS predicted_clv, 'standard_loyalty_program' AS recommended_action, 'batch_holdout' AS data_source
FROM hist""", views=["scores"], ctes=[HIST], doubles=["churn_probability", "latency_ms", "predicted_clv"]))
def q_scoring_history(spark, sf):
    """100 sampled predictions spread over the 24 h before the end time."""
    pred = tb.scores(spark, sf).select("customer_id", "churn_probability", "segment", F.floor("clv").alias("predicted_clv"))
    return scr.scoring_history(pred, N_HISTORY, END_TS)


#: Every event as a scored request: probability and latency from its id, errors as they are.
LOG = """slog AS (SELECT event_id AS message_id, user_id AS customer_id, ts AS "timestamp",
    ((event_id * 7919) % 997) / 997.0 AS churn_probability,
    CASE WHEN event_id % 50 <> 0 THEN 18.0 + ((event_id * 7919) % 997) / 997.0 * 12.0 + (event_id % 7) * 0.35 END AS latency_ms,
    event_type = 'error' AS scoring_error FROM events)"""
TTL = 7 * 86400


def _log(spark, sf):
    e = tb.read_table(spark, sf, "events")
    k = F.col("event_id")
    p = (k * 7919) % 997 / 997.0
    return e.select(k.alias("message_id"), F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("timestamp"),
                    p.alias("churn_probability"),
                    F.when(k % 50 != 0, 18.0 + p * 12.0 + (k % 7) * 0.35).alias("latency_ms"),
                    (F.col("event_type") == "error").alias("scoring_error"))


@register("throughput", oracle("""SELECT time_bucket(INTERVAL 15 MINUTE, "timestamp") AS "timestamp",
  round(count(*) / 15.0, 4) AS requests_per_minute, round(avg(greatest(coalesce(latency_ms, med), 1.0)), 2) AS avg_latency_ms,
  round(least(count_if(scoring_error) / count(*), 1.0), 6) AS error_rate, count(*) AS requests,
  'batch_scoring_history' AS data_source
FROM slog CROSS JOIN (SELECT median(latency_ms) AS med FROM slog) GROUP BY 1""", views=[], ctes=[LOG],
    doubles=["requests_per_minute", "avg_latency_ms", "error_rate"]))
def q_throughput(spark, sf):
    """15-minute throughput windows of all scored events."""
    return scr.throughput(_log(spark, sf))


@register("hourly_scores", oracle("""SELECT date_trunc('hour', "timestamp") AS hour, count(*) AS count,
  avg(churn_probability) AS mean_probability, stddev_samp(churn_probability) AS std_probability FROM slog GROUP BY 1""",
    views=[], ctes=[LOG], doubles=["mean_probability", "std_probability"]))
def q_hourly_scores(spark, sf):
    """Hourly scoring statistics of all scored events."""
    return scr.hourly_scores(_log(spark, sf))


@register("latest_prediction", oracle(f"""SELECT customer_id, "timestamp", churn_probability,
  CASE WHEN churn_probability >= 0.75 THEN 'critical' WHEN churn_probability >= 0.5 THEN 'high'
       WHEN churn_probability >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level, age_seconds FROM (
  SELECT *, CAST(floor(epoch(mx)) - floor(epoch("timestamp")) AS BIGINT) AS age_seconds FROM (
    SELECT *, max("timestamp") OVER () AS mx, row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC,
      message_id DESC) AS r FROM slog) WHERE r = 1) WHERE age_seconds <= {TTL}""", views=[], ctes=[LOG],
    doubles=["churn_probability"], ints=["age_seconds"]))
def q_latest_prediction(spark, sf):
    """T9 (batch): latest prediction per customer, valid for 7 days at the time of the last event."""
    from churnlens.functions.columns import risk_level_left_closed
    h = _log(spark, sf).withColumn("risk_level", risk_level_left_closed("churn_probability"))
    now = h.agg(F.max("timestamp")).first()[0]
    return scr.latest_prediction(h, now, TTL, tie="message_id")


@register("freshness", oracle(f"""SELECT max("timestamp") AS latest,
  (floor(epoch(TIMESTAMP '{END_TS}')) - floor(epoch(max("timestamp")))) / 3600.0 AS age_hours FROM slog""",
    views=[], ctes=[LOG], doubles=["age_hours"]))
def q_freshness(spark, sf):
    """Newest scoring timestamp and its age."""
    return scr.freshness(_log(spark, sf), "timestamp", END_TS)


@register("trim_responses", oracle("""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC,
  message_id DESC) AS r FROM slog) WHERE r <= 50""", views=[], ctes=[LOG],
    doubles=["churn_probability", "latency_ms"]))
def q_trim(spark, sf):
    """Keep the last 50 responses of all scored events."""
    return scr.trim(_log(spark, sf), 50)


@register("stream_throughput", oracle("""SELECT time_bucket(INTERVAL 15 MINUTE, "timestamp") AS "timestamp", count(*) AS requests,
  round(count(*) / 15.0, 4) AS requests_per_minute FROM feat GROUP BY 1""", views=V, ctes=CTES,
    doubles=["requests_per_minute"]))
def q_stream_throughput(spark, sf):
    """T10 (stream): 15-minute windows of the request stream, all of them."""
    sink = _scratch(spark, "throughput-sink")
    st.stream_throughput(spark, _requests(spark, sf), sink, _scratch(spark, "throughput-checkpoint"))
    return st.throughput_table(spark, sink)


@register("stream_latest_prediction", oracle("""SELECT CAST(f.customer_id AS VARCHAR) AS customer_id, s.churn_probability,
  f."timestamp" AS scored_at FROM feat f JOIN scored s ON f.customer_id = s.customer_id""", views=V, ctes=CTES + [SCORED],
    doubles=["churn_probability"]))
def q_stream_latest(spark, sf):
    """T9 (stream): the latest prediction of every customer of the request stream."""
    sink = _scratch(spark, "latest-sink")
    resp = st.responses(st.read_requests(spark, _requests(spark, sf)), NP, NL).withColumn("scored_at", F.to_timestamp("scored_at"))
    st.latest_prediction_stream(resp, sink, _scratch(spark, "latest-checkpoint"))
    return st.latest_prediction_table(spark, sink)


def _log_files(spark, sf) -> str:
    """All scored events as request files of a stream."""
    path = _scratch(spark, "scored")
    (_log(spark, sf).select(F.col("message_id").cast("string").alias("message_id"), F.col("customer_id").cast("string").alias("customer_id"),
                            F.col("timestamp").alias("scored_at"), "churn_probability")
     .repartitionByRange(4, "scored_at").write.parquet(path))
    return path


def _log_stream(spark, path: str):
    schema = "message_id string, customer_id string, scored_at timestamp, churn_probability double"
    return ss.state_session(spark).readStream.schema(schema).parquet(path)


@register("stream_live_predictions", oracle(f"""SELECT customer_id, "timestamp" AS scored_at, churn_probability FROM (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, "timestamp", churn_probability, max("timestamp") OVER () AS mx,
    row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, churn_probability DESC) AS r FROM slog)
WHERE r = 1 AND epoch(mx) - epoch("timestamp") <= {TTL}""", views=[], ctes=[LOG], doubles=["churn_probability"]))
def q_stream_live_predictions(spark, sf):
    """T9 (stream): predictions not older than 7 days, expired by timers on the state store."""
    sink = _scratch(spark, "live-sink")
    ss.latest_with_ttl_stream(_log_stream(spark, _log_files(spark, sf)), sink, _scratch(spark, "live-checkpoint"), TTL)
    return ss.live_predictions(spark, sink)


@register("stream_recent_responses", oracle("""SELECT CAST(message_id AS VARCHAR) AS message_id, CAST(customer_id AS VARCHAR) AS customer_id,
  "timestamp" AS scored_at, churn_probability FROM (
  SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, CAST(message_id AS VARCHAR) DESC) AS r FROM slog) WHERE r <= 50""",
    views=[], ctes=[LOG], doubles=["churn_probability"]))
def q_stream_recent_responses(spark, sf):
    """T14 (stream): the last 50 responses, kept in bounded lists of the state store."""
    sink = _scratch(spark, "recent-sink")
    ss.recent_responses_stream(_log_stream(spark, _log_files(spark, sf)), sink, _scratch(spark, "recent-checkpoint"), 50)
    return ss.recent_responses(spark, sink, 50)
