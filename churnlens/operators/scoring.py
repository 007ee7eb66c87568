"""Request scoring, scoring history and throughput (T1-T3, T9-T14), batch side.

All expressions are column functions so the same code scores a static table and a
micro-batch of a stream (``churnlens.streaming.scorer``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import risk_level_left_closed
from churnlens.functions.prefix import global_order

# The scoring feature contract and the action per risk level.
NUMERIC_FEATURES = ("recency", "frequency", "monetary", "avg_order_value", "days_since_last_purchase",
                    "days_since_last_login", "total_purchases", "session_count_30d", "avg_session_duration",
                    "coupon_usage_rate", "cart_abandonment_rate", "review_count", "cs_contact_count",
                    "preferred_category_encoded", "segment_encoded")
REQUIRED_FEATURES = ("customer_id",) + NUMERIC_FEATURES
RISK_ACTIONS = {"critical": "immediate_personal_outreach", "high": "win_back_campaign_with_discount",
                "medium": "engagement_email_campaign", "low": "standard_loyalty_program"}


# Names of the value types in error texts (fixed values that must equal the reference's).
TYPE_NAMES = {"string": "str", "char": "str", "varchar": "str", "double": "float", "float": "float", "decimal": "Decimal",
              "array": "list", "map": "dict", "struct": "dict", "timestamp": "datetime", "timestamp_ntz": "datetime",
              "date": "date", "binary": "bytes", "void": "NoneType"}
NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "boolean")


def validate_features(df: DataFrame) -> DataFrame:
    """``errors`` array per row -- a missing column, and a value of another type than a number
    (null is valid) or, for the customer id, than text or a whole number."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    errs = []
    for name in REQUIRED_FEATURES:
        kind = kinds.get(name)
        got = TYPE_NAMES.get(kind, kind)
        if kind is None:
            errs.append(F.lit(f"Missing required feature: {name}"))
        elif name == "customer_id":
            if kind in ("string", "byte", "short", "integer", "long", "boolean"):
                got = F.when(F.col(name).isNull(), F.lit("NoneType"))
            else:
                got = F.when(F.col(name).isNull(), F.lit("NoneType")).otherwise(F.lit(got))
            errs.append(F.when(got.isNotNull(), F.concat(F.lit("customer_id must be str or int, got "), got)))
        elif kind not in NUMERIC_TYPES:
            errs.append(F.when(F.col(name).isNotNull(), F.lit(f"Feature '{name}' must be numeric, got {got}")))
    arr = F.array_compact(F.array(*errs)) if errs else F.array().cast("array<string>")
    return df.withColumn("errors", arr).withColumn("valid", F.size("errors") == 0)


def _num(name: str, default: float) -> Column:
    """``float(x or default)``: null, missing or 0 take the default."""
    c = F.col(name).cast("double")
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def heuristic_score(no_purchase_days: int = 30, no_login_days: int = 60) -> Column:
    """Weighted recency / frequency / session / cart signals, clipped to [0, 1]."""
    dp = F.coalesce(F.col("days_since_last_purchase").cast("double"), F.lit(0.0))
    dl = F.coalesce(F.col("days_since_last_login").cast("double"), F.lit(0.0))
    raw = (F.least(dp / no_purchase_days, F.lit(2.0)) * 0.3 + F.least(dl / no_login_days, F.lit(2.0)) * 0.2
           + F.greatest(F.lit(0.0), 1.0 - _num("frequency", 5.0) / 10.0) * 0.2
           + F.greatest(F.lit(0.0), 1.0 - _num("session_count_30d", 10.0) / 20.0) * 0.15
           + F.least(_num("cart_abandonment_rate", 0.2), F.lit(1.0)) * 0.15)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def score_batch(df: DataFrame, no_purchase_days: int = 30, no_login_days: int = 60,
                scored_at: Column | None = None) -> DataFrame:
    """Probability, left-closed risk level and the action for that risk."""
    p = heuristic_score(no_purchase_days, no_login_days)
    act = F.create_map(*[x for k, v in RISK_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    out = df.withColumn("churn_probability", p).withColumn("risk_level", risk_level_left_closed("churn_probability"))
    out = out.withColumn("recommended_action", act[F.col("risk_level")]).withColumn("model_type", F.lit("heuristic"))
    return out.withColumn("scored_at", scored_at) if scored_at is not None else out


def latest_prediction(history: DataFrame, now, ttl_seconds: int, tie: str = "churn_probability") -> DataFrame:
    """T9 (batch): each customer's latest prediction (of equal times the largest ``tie``), kept
    while not older than the TTL."""
    cols = [c for c in ("timestamp", tie, "churn_probability", "risk_level") if c in history.columns]
    g = history.groupBy("customer_id").agg(F.max(F.struct(*dict.fromkeys(cols))).alias("__l"))
    n = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    age = F.unix_timestamp(n) - F.unix_timestamp(F.col("__l.timestamp"))
    return g.select("customer_id", *[F.col(f"__l.{c}").alias(c) for c in ("timestamp", "churn_probability", "risk_level")],
                    age.alias("age_seconds")).filter(F.col("age_seconds") <= ttl_seconds)


def throughput(history: DataFrame, minutes: int = 15) -> DataFrame:
    """Tumbling windows -- requests, mean latency (nulls -> median latency, floor 1 ms),
    errors, requests per minute, error rate; empty windows do not appear."""
    from churnlens.functions.quantiles import grouped_quantiles
    med = grouped_quantiles(history, "latency_ms", [0.5]).select(F.col("q").alias("__med"))
    h = history.crossJoin(F.broadcast(med)).withColumn(
        "__lat", F.greatest(F.coalesce(F.col("latency_ms"), F.col("__med")), F.lit(1.0)))
    g = h.groupBy(F.window("timestamp", f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.avg("__lat").alias("avg_latency_ms"),
        F.count_if(F.coalesce(F.col("scoring_error"), F.lit(False))).alias("error_count"))
    return g.select(F.col("w.start").alias("timestamp"),
                    F.round(F.col("requests") / float(minutes), 4).alias("requests_per_minute"),
                    F.round("avg_latency_ms", 2).alias("avg_latency_ms"),
                    F.round(F.least(F.col("error_count") / F.col("requests"), F.lit(1.0)), 6).alias("error_rate"),
                    "requests", F.lit("batch_scoring_history").alias("data_source"))


def hourly_scores(history: DataFrame) -> DataFrame:
    """Count, mean and std of the probability by hour."""
    return history.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("churn_probability").alias("mean_probability"),
        F.stddev_samp("churn_probability").alias("std_probability"))


def scoring_history(pred: DataFrame, n: int, end_ts: str, seed: int = 42, model_version: str = "ensemble_v1") -> DataFrame:
    """A sample of n predictions without replacement (lowest seeded hashes -- a sampling
    operator), their times evenly spaced over the 24 h up to ``end_ts``, both ends included and
    cut to seconds, and the latency 18 + 12 p + 0.35 (i mod 7) ms."""
    from churnlens.functions.columns import risk_level_right_closed
    from churnlens.operators.stats import mix_hash
    h = pred.withColumn("__h", mix_hash("customer_id", seed))
    r = global_order(h, [("__h", True), ("customer_id", True)], rank_col="__i").filter(F.col("__i") <= n)
    size = r.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("__steps"))     # one row
    r = r.crossJoin(F.broadcast(size))
    i, p = F.col("__i") - 1, F.col("churn_probability").cast("double")
    back = F.lit(86400.0) - i * 86400.0 / F.col("__steps")
    ts = F.timestamp_seconds(F.floor(F.unix_timestamp(F.lit(end_ts).cast("timestamp")) - back))
    given = lambda c, default: F.coalesce(F.col(c), default) if c in pred.columns else default
    return r.select(
        ts.alias("timestamp"), ts.alias("scored_at"), F.col("customer_id").cast("string").alias("customer_id"),
        F.round(p, 6).alias("churn_probability"), risk_level_right_closed(p).alias("risk_level"),
        F.lit(model_version).alias("model_version"), F.lit(model_version).alias("model_type"),
        F.round(18.0 + F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 12.0 + (i % 7) * 0.35, 2).alias("latency_ms"),
        F.lit(False).alias("scoring_error"), given("segment", F.lit("unknown")).alias("segment"),
        F.round(given("predicted_clv", F.lit(0.0)), 2).alias("predicted_clv"),
        given("recommended_action", F.lit("standard_loyalty_program")).alias("recommended_action"),
        F.lit("batch_holdout").alias("data_source"))


def freshness(df: DataFrame, ts_col: str, now) -> DataFrame:
    """Latest timestamp and its age in hours."""
    n = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return df.agg(F.max(ts_col).alias("latest")).select(
        "latest", ((F.unix_timestamp(n) - F.unix_timestamp("latest")) / 3600.0).alias("age_hours"))


def trim(df: DataFrame, n: int, ts_col: str = "timestamp", id_col: str = "message_id") -> DataFrame:
    """Keep the last ``n`` messages (distributed rank, newest first)."""
    r = global_order(df, [(ts_col, False), (id_col, False)], rank_col="__r")
    return r.filter(F.col("__r") <= n).drop("__r")
