"""Churn label and per-customer features.

Scale design: raw events are scanned once into a per-(customer, day) rollup with one
count column per event type. Nearly every feature is a function of that table, which
is at most (customers x active days) rows, so a customer holding a third of all events
collapses to a few hundred rows before any join-back. Only the hour-of-day profile and
the purchase-order trend read events again, both through skew-safe aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.config import EVENT_CODES, EVENT_TYPES, ChurnParams
from churnlens.functions.columns import safe_div
from churnlens.functions.prefix import global_order, top_k_per_group
from churnlens.functions.quantiles import grouped_quantiles, quantiles_from_counts, value_counts
from churnlens.session import cut_lineage

CHANGE_COLS = ("visit_frequency_change", "purchase_cycle_change", "session_duration_change",
               "cart_conversion_change", "coupon_response_change", "search_intensity_change",
               "cs_contact_change")
# Columns never clipped by the sanitiser (fixed values).
SANITIZE_EXCLUDE = ("customer_id", "churn_label", "journey_stage", "behavior_pattern_cluster",
                    "peak_hour")


def _n(t: str) -> str:
    return f"n_{t}"


def _date(d) -> Column:
    if isinstance(d, Column):
        return d
    return F.to_date(F.lit(str(d)))


def max_date_plus(events: DataFrame, days: int = 1, col: str = "event_date") -> Column:
    """Scalar subquery ``max(col) + days`` (stays lazy; no driver round trip)."""
    return events.agg(F.date_add(F.max(col), days)).scalar()


# ------------------------------------------------------------------ daily rollup

def daily_rollup(events: DataFrame) -> DataFrame:
    """One row per (customer, day): event counts per type, sessions, purchase amount."""
    et = F.col("event_type")
    aggs = [F.count(F.lit(1)).alias("n_events")]
    aggs += [F.count_if(et == t).alias(_n(t)) for t in EVENT_TYPES]
    aggs += [F.sum("session_duration").alias("sess_sum"),
             F.count("session_duration").alias("sess_n"),
             F.sum(F.when(et == "purchase", F.col("amount"))).alias("purchase_amount")]
    return events.filter(F.col("event_date").isNotNull()).groupBy("customer_id", "event_date").agg(*aggs)


# ------------------------------------------------------------------ F1

def label_churn(customers: DataFrame, events: DataFrame, end_date, p: ChurnParams = ChurnParams()) -> DataFrame:
    """days since last purchase / last page_view-or-search at ``end_date``."""
    et = F.col("event_type")
    last = events.groupBy("customer_id").agg(
        F.max(F.when(et == "purchase", F.col("event_date"))).alias("last_purchase"),
        F.max(F.when(et.isin("page_view", "search"), F.col("event_date"))).alias("last_login"))
    end = _date(end_date)
    dp = F.coalesce(F.datediff(end, "last_purchase"), F.lit(p.simulation_days))
    dl = F.coalesce(F.datediff(end, "last_login"), F.lit(p.simulation_days))
    a, b = dp >= p.no_purchase_days, dl >= p.no_login_days
    lab = (a | b) if p.mode == "or" else (a & b)
    return (customers.select("customer_id").join(last, "customer_id", "left")
            .select("customer_id", dp.alias("days_since_purchase"), dl.alias("days_since_login"),
                    lab.cast("int").alias("churn_label")))


# ------------------------------------------------------------------ F2

def rfm(customers: DataFrame, events: DataFrame, ref_date) -> DataFrame:
    """recency (365 if none, clipped >= 0), frequency, monetary, AOV, monetary/day."""
    pur = events.filter(F.col("event_type") == "purchase")
    agg = pur.groupBy("customer_id").agg(F.max("event_date").alias("last_purchase"),
                                         F.count("event_date").alias("frequency"),
                                         F.sum("amount").alias("monetary"))
    ref = _date(ref_date)
    rec = F.greatest(F.coalesce(F.datediff(ref, "last_purchase"), F.lit(365)), F.lit(0))
    out = (customers.select("customer_id").join(agg, "customer_id", "left")
           .select("customer_id", rec.cast("double").alias("recency"),
                   F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"),
                   F.coalesce("monetary", F.lit(0.0)).alias("monetary")))
    return (out.withColumn("avg_order_value",
                           F.when(F.col("frequency") > 0, F.col("monetary") / F.col("frequency"))
                           .otherwise(0.0))
            .withColumn("monetary_per_day",
                        F.when(F.col("recency") == 366, F.lit(float("inf")))
                        .when(F.col("recency") > 0, F.col("monetary") / (365 - F.col("recency") + 1))
                        .otherwise(0.0)))


# ------------------------------------------------------------------ per-customer statistics

HALF_TYPES = ("page_view", "purchase", "add_to_cart", "coupon_use", "search", "cs_contact")


def customer_stats(daily: DataFrame) -> DataFrame:
    """One row per customer with every sum the daily-based features need.

    The customer's own first / last day come from a window over the daily rows
    (bounded: one row per active day), so the whole thing is one shuffle by customer
    and one aggregate that reuses that partitioning.
    """
    w = Window.partitionBy("customer_id")
    d = (daily.withColumn("dmin", F.min("event_date").over(w))
         .withColumn("dmax", F.max("event_date").over(w)))
    first = (2 * F.datediff("event_date", "dmin")) <= F.datediff("dmax", "dmin")
    recent = F.col("event_date") > F.date_sub("dmax", 30)
    npur = F.col(_n("purchase"))
    aggs = [F.first("dmin").alias("dmin"), F.first("dmax").alias("dmax"),
            F.count(F.lit(1)).alias("visit_days"), F.sum("n_events").alias("n_events"),
            F.sum("sess_sum").alias("sess_sum"), F.sum("sess_n").alias("sess_n")]
    aggs += [F.sum(_n(t)).alias(_n(t)) for t in EVENT_TYPES]
    for t in HALF_TYPES:
        aggs += [F.sum(F.when(first, F.col(_n(t))).otherwise(0)).alias(f"a_{t}"),
                 F.sum(F.when(~first, F.col(_n(t))).otherwise(0)).alias(f"b_{t}")]
    aggs += [F.sum(F.when(first, F.col("sess_sum"))).alias("a_ss"),
             F.sum(F.when(first, F.col("sess_n"))).alias("a_sn"),
             F.sum(F.when(~first, F.col("sess_sum"))).alias("b_ss"),
             F.sum(F.when(~first, F.col("sess_n"))).alias("b_sn"),
             F.min(F.when(npur > 0, F.col("event_date"))).alias("pmin"),
             F.max(F.when(npur > 0, F.col("event_date"))).alias("pmax"),
             F.sum("purchase_amount").alias("p_amount"),
             F.sum(F.when(F.weekday("event_date") >= 5, npur).otherwise(0)).alias("wk_purchases"),
             F.var_samp("n_events").alias("day_var"),
             F.sum(F.when(recent, F.col("n_events")).otherwise(0)).alias("rc")]
    return d.groupBy("customer_id").agg(*aggs)


def _with_stats(customers: DataFrame, stats: DataFrame) -> DataFrame:
    return customers.select("customer_id").join(stats, "customer_id", "left")


def change_cols() -> list[Column]:
    """F3 expressions over ``customer_stats`` (0 for customers without events)."""
    hd = F.greatest(F.floor(F.datediff("dmax", "dmin") / 2), F.lit(1))

    def rate_change(t):
        return safe_div(F.col(f"b_{t}") / hd, F.col(f"a_{t}") / hd)
    conv_a = safe_div("a_purchase", "a_add_to_cart")
    conv_b = safe_div("b_purchase", "b_add_to_cart")
    cols = [rate_change("page_view"), rate_change("purchase"),
            safe_div(safe_div("b_ss", "b_sn", None), safe_div("a_ss", "a_sn", None)),
            safe_div(conv_b, conv_a), rate_change("coupon_use"), rate_change("search"),
            rate_change("cs_contact")]
    return [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(cols, CHANGE_COLS)]


def cycle_cols(ref_date) -> list[Column]:
    """F4 expressions: mean purchase gap (telescopes to span / (n - 1)), overdue ratio."""
    ref = _date(ref_date)
    np_ = F.col(_n("purchase"))
    has = F.col("pmax").isNotNull()
    enough = has & (np_ >= 2)
    avg_cycle = F.datediff("pmax", "pmin") / (np_ - 1)
    since = F.greatest(F.datediff(ref, "pmax"), F.lit(0)).cast("double")
    anomaly = (F.when(~has, 2.0).when(np_ == 1, 1.5)
               .otherwise(F.greatest(safe_div(since, avg_cycle, 2.0), F.lit(0.0))))
    return [anomaly.alias("purchase_cycle_anomaly"),
            F.when(enough, avg_cycle).otherwise(0.0).alias("avg_purchase_cycle_days"),
            F.when(enough, since).otherwise(0.0).alias("days_since_last_purchase")]


def session_cols() -> list[Column]:
    """F5 expressions: session length (fallback events per active day), rates."""
    vd = F.greatest(F.col("visit_days"), F.lit(1))
    rng = F.greatest(F.datediff("dmax", "dmin") + 1, F.lit(1))
    cols = [F.coalesce(safe_div("sess_sum", "sess_n", None), F.col("n_events") / vd),
            F.col(_n("page_view")) / vd,
            safe_div(_n("purchase"), _n("search")),
            safe_div(_n("remove_from_cart"), _n("add_to_cart")),
            F.col("n_events") / rng]
    names = ["avg_session_duration", "pageviews_per_session", "search_to_purchase_rate",
             "cart_abandonment_rate", "avg_events_per_day"]
    return [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(cols, names)]


def sequence_cols() -> list[Column]:
    """F7 expressions: event types seen, total events of the 8 types."""
    div = sum(F.when(F.col(_n(t)) > 0, 1).otherwise(0) for t in EVENT_TYPES)
    ln = sum(F.coalesce(F.col(_n(t)), F.lit(0)) for t in EVENT_TYPES)
    return [div.cast("long").alias("sequence_diversity"), ln.cast("long").alias("sequence_length")]


def daily_time_cols() -> list[Column]:
    """F10 daily part: weekend purchase share, variance of daily counts."""
    return [F.coalesce(safe_div("wk_purchases", _n("purchase"), None), F.lit(0.0)).alias("weekend_purchase_ratio"),
            F.coalesce(F.col("day_var"), F.lit(0.0)).alias("day_variance")]


def journey_cols() -> list[Column]:
    """F11 expressions: onboarding 0, growing 1, mature 2, declining 3, dormant 4, stage tenure."""
    span_ = F.greatest(F.datediff("dmax", "dmin"), F.lit(0))
    rc, pc = F.col("rc").cast("double"), F.col(_n("purchase"))
    rr = rc / 30.0
    older = F.when(span_ > 30, (F.col("n_events") - rc) / F.greatest(span_ - 30, F.lit(1))).otherwise(rr)
    onb = span_ < 30
    grow = ~onb & (rr > older * 1.2)
    mat = ~onb & ~grow & (rr > older * 0.8) & (pc >= 3)
    dec = ~onb & ~grow & ~mat & (rr < older * 0.5)
    rem = ~(onb | grow | mat | dec)
    dorm = rem & (rr < 0.1)
    still = rem & ~dorm & (pc < 2)
    stage = F.when(onb | still, 0).when(grow, 1).when(mat, 2).when(dec, 3).when(dorm, 4).otherwise(2)
    tenure_ = F.greatest(F.when(grow, F.least(F.lit(30), span_)).when(dec | dorm, 30).otherwise(span_), F.lit(0))
    none = F.col("dmax").isNull()
    return [F.when(none, 4).otherwise(stage).cast("int").alias("journey_stage"),
            F.when(none, 0).otherwise(tenure_).cast("int").alias("stage_tenure_days")]


def activity_rfm_cols(ref_date) -> list[Column]:
    """F2 expressions from the daily statistics (purchases of the activity events)."""
    ref = _date(ref_date)
    rec = F.greatest(F.coalesce(F.datediff(ref, "pmax"), F.lit(365)), F.lit(0)).cast("double")
    freq = F.coalesce(F.col(_n("purchase")), F.lit(0)).cast("long")
    mon = F.coalesce(F.col("p_amount"), F.lit(0.0))
    return [rec.alias("recency"), freq.alias("frequency"), mon.alias("monetary"),
            F.when(freq > 0, mon / freq).otherwise(0.0).alias("avg_order_value"),
            F.when(rec == 366, F.lit(float("inf"))).when(rec > 0, mon / (365 - rec + 1)).otherwise(0.0)
            .alias("monetary_per_day")]


def behavior_changes(customers: DataFrame, daily: DataFrame) -> DataFrame:
    """second-half / first-half rates, split at each customer's own midpoint."""
    return _with_stats(customers, customer_stats(daily)).select("customer_id", *change_cols())


def purchase_cycle(customers: DataFrame, daily: DataFrame, ref_date) -> DataFrame:
    """purchase-cycle anomaly."""
    return _with_stats(customers, customer_stats(daily)).select("customer_id", *cycle_cols(ref_date))


def session_quality(customers: DataFrame, daily: DataFrame) -> DataFrame:
    """session quality features."""
    return _with_stats(customers, customer_stats(daily)).select("customer_id", *session_cols())


def event_counts(daily: DataFrame) -> DataFrame:
    """customer x 8 event types, zero filled."""
    return daily.groupBy("customer_id").agg(*[F.sum(_n(t)).alias(t) for t in EVENT_TYPES])


def sequence_stats(customers: DataFrame, daily: DataFrame) -> DataFrame:
    """number of event types seen and total events of the 8 types."""
    return _with_stats(customers, customer_stats(daily)).select("customer_id", *sequence_cols())


# ------------------------------------------------------------------ F8, F9

def purchase_trend(customers: DataFrame, events: DataFrame) -> DataFrame:
    """F8: Pearson correlation of purchase index (date order, then event id) and amount."""
    pur = (events.filter(F.col("event_type") == "purchase")
           .select("customer_id", "event_date", "event_id",
                   F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount")))
    ranked = global_order(pur, [("event_date", True), ("event_id", True)], partition_by=["customer_id"],
                          rank_col="idx")
    g = ranked.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.stddev_pop("amount").alias("sd"),
                                          F.corr(F.col("idx").cast("double"), "amount").alias("r"))
    tr = F.when((F.col("n") < 2) | (F.col("sd") == 0) | F.col("r").isNull() | F.isnan("r"), 0.0) \
        .otherwise(F.col("r"))
    return customers.select("customer_id").join(g.select("customer_id", tr.alias("purchase_sequence_trend")),
                                                "customer_id", "left") \
        .na.fill(0.0, ["purchase_sequence_trend"])


def behavior_cluster(customers: DataFrame, daily: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k-means (k = min(5, n)) on each customer's event-type share vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    c = customers.select("customer_id").join(event_counts(daily), "customer_id", "left").na.fill(0)
    tot = sum(F.col(t) for t in EVENT_TYPES)
    shares = c.select("customer_id", *[safe_div(F.col(t), tot).alias(f"s_{t}") for t in EVENT_TYPES])
    n = customers.count()
    kk = min(k, n)
    if kk < 2:
        return shares.select("customer_id", F.lit(0).alias("behavior_pattern_cluster"))
    x = VectorAssembler(inputCols=[f"s_{t}" for t in EVENT_TYPES], outputCol="features").transform(shares)
    model = KMeans(k=kk, seed=seed, featuresCol="features", predictionCol="behavior_pattern_cluster").fit(x)
    return model.transform(x).select("customer_id", "behavior_pattern_cluster")


# ------------------------------------------------------------------ F10

def hourly_profile(events: DataFrame) -> DataFrame:
    """(customer, hour) event counts; at most 24 rows per customer."""
    return (events.filter(F.col("timestamp").isNotNull())
            .groupBy("customer_id", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("cnt")))


def hourly_cols_table(hourly: DataFrame) -> DataFrame:
    """F10 hour part: morning / evening / night shares, peak hour (lowest hour on ties)."""
    h = F.col("hour")
    return hourly.groupBy("customer_id").agg(
        (F.sum(F.when((h >= 6) & (h < 12), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("morning_activity_ratio"),
        (F.sum(F.when((h >= 18) & (h < 22), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("evening_activity_ratio"),
        (F.sum(F.when((h >= 22) | (h < 6), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("night_activity_ratio"),
        F.max_by("hour", F.col("cnt") * 100 - h).alias("peak_hour"))


TIME_COLS = ["weekend_purchase_ratio", "evening_activity_ratio", "morning_activity_ratio",
             "night_activity_ratio", "peak_hour", "day_variance"]


def _hour_out() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
            ("evening_activity_ratio", "morning_activity_ratio", "night_activity_ratio")] + \
        [F.coalesce(F.col("peak_hour"), F.lit(12)).cast("int").alias("peak_hour")]


def time_features(customers: DataFrame, daily: DataFrame, hourly: DataFrame) -> DataFrame:
    """weekend purchase share, morning / evening / night shares, peak hour, day variance."""
    out = _with_stats(customers, customer_stats(daily)).select("customer_id", *daily_time_cols())
    out = out.join(hourly_cols_table(hourly), "customer_id", "left")
    return out.select("customer_id", "weekend_purchase_ratio", *_hour_out(), "day_variance").select(
        "customer_id", *TIME_COLS)


def journey_stage(customers: DataFrame, daily: DataFrame) -> DataFrame:
    """journey stage and stage tenure."""
    return _with_stats(customers, customer_stats(daily)).select("customer_id", *journey_cols())


def tenure(customers: DataFrame, ref_date) -> DataFrame:
    """max(0, ref - signup) days."""
    return customers.select("customer_id",
                            F.greatest(F.datediff(_date(ref_date), "signup_date"), F.lit(0)).alias("tenure_days"))


# ------------------------------------------------------------------ Q6, F13

def sanitize_features(df: DataFrame, exclude=SANITIZE_EXCLUDE) -> DataFrame:
    """Q6: +-inf / NaN / null -> 0; clip to the [1%, 99%] quantiles unless <= 2 distinct values.

    Quantiles and distinct counts come from one long-form (feature, value) pass, so the
    work is distributed by feature and value, never one column in one task.
    """
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long", "short")
           and f.name not in exclude]
    if not num:
        return df
    numset = set(num)

    def qi(c):
        return "`" + c.replace("`", "``") + "`"

    def clean(c):
        x = f"CAST({qi(c)} AS DOUBLE)"
        return f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('inf') THEN 0 ELSE {qi(c)} END AS {qi(c)}"
    # one projection for all columns, as SQL text: a withColumn loop re-analyses the plan
    # per column and Column objects cost many gateway calls each
    cleaned = df.selectExpr(*[clean(c) if c in numset else qi(c) for c in df.columns])
    long = cleaned.select(*[F.col(c).cast("double").alias(c) for c in num]).unpivot([], num, "feature", "value")
    vals = value_counts(long, "value", ["feature"])
    q = quantiles_from_counts(vals, [0.01, 0.99], ["feature"])
    # distinct values per feature (NaN / null were zeroed above, so none are dropped)
    nd = vals.groupBy("feature").agg(F.count(F.lit(1)).alias("nd"))
    rows = q.join(nd, "feature").collect()      # 2 rows per numeric column
    bounds: dict[str, dict] = {}
    for r in rows:
        bounds.setdefault(r["feature"], {"nd": r["nd"]})[r["q_index"]] = r["q"]
    def clip(c):
        x = f"CAST({qi(c)} AS DOUBLE)"
        b = bounds.get(c)
        lo, hi = (b.get(0), b.get(1)) if b else (None, None)
        if b and b["nd"] > 2 and lo is not None and hi is not None and lo < hi:
            x = f"least(greatest({x}, CAST('{float(lo)!r}' AS DOUBLE)), CAST('{float(hi)!r}' AS DOUBLE))"
        return f"{x} AS {qi(c)}"
    return cleaned.selectExpr(*[clip(c) if c in numset else qi(c) for c in cleaned.columns])


def build_features(customers: DataFrame, events: DataFrame, ref_date, *, with_cluster: bool = True,
                   sanitize: bool = True) -> DataFrame:
    """the 33-feature matrix, one row per customer.

    Plan: events -> daily rollup -> customer statistics (one shuffle by customer), hour
    profile, purchase trend; three left joins on ``customer_id``; one sanitiser pass.
    """
    daily = daily_rollup(events)
    stats = customer_stats(daily)
    hours = hourly_cols_table(hourly_profile(events))
    trend = purchase_trend(customers, events)
    base = customers.select("customer_id", "persona", "churn_label", "treatment_group", "signup_date")
    j = (base.join(stats, "customer_id", "left").join(hours, "customer_id", "left")
         .join(trend, "customer_id", "left"))
    out = j.select(
        "customer_id", "persona", "churn_label", "treatment_group", "signup_date",
        *activity_rfm_cols(ref_date), *change_cols(), *cycle_cols(ref_date), *session_cols(),
        *sequence_cols(), F.coalesce("purchase_sequence_trend", F.lit(0.0)).alias("purchase_sequence_trend"),
        daily_time_cols()[0], *_hour_out(), daily_time_cols()[1], *journey_cols(),
        F.greatest(F.datediff(_date(ref_date), "signup_date"), F.lit(0)).alias("tenure_days"))
    if with_cluster:
        out = out.join(behavior_cluster(customers, daily), "customer_id", "left")
    if not sanitize:
        return out
    # the sanitiser reads the matrix several times: cut the lineage once
    return sanitize_features(cut_lineage(out))


# ------------------------------------------------------------------ F14-F18

def monthly_panel(events: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """per (customer, month) counts and amount; static features joined, nulls 0."""
    et = F.col("event_type")
    p = events.groupBy("customer_id", F.trunc("event_date", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(et == "purchase").alias("purchase_count"),
        F.count_if(et == "page_view").alias("page_view_count"),
        F.count_if(et == "search").alias("search_count"),
        F.count_if(et.isin("add_to_cart", "remove_from_cart")).alias("cart_count"),
        F.count_if(et == "coupon_use").alias("coupon_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))
    if static is not None:
        p = p.join(static, "customer_id", "left")
        p = p.na.fill(0)
    return p


def event_sequences(events: DataFrame, length: int = 50) -> DataFrame:
    """last ``length`` events as integer codes, oldest first, left-padded with 0."""
    code = F.coalesce(F.create_map(*[x for t, c in EVENT_CODES.items() for x in (F.lit(t), F.lit(c))])
                      [F.col("event_type")], F.lit(0))
    e = events.select("customer_id", "timestamp", "event_id", code.alias("code"))
    last = top_k_per_group(e, ["customer_id"], [F.desc("timestamp"), F.desc("event_id")], length,
                           salt_col="event_id")
    g = last.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "event_id", "code"))).alias("s"))
    codes = F.transform("s", lambda x: x["code"])
    pad = F.array_repeat(F.lit(0), F.lit(length) - F.size(codes))
    return g.select("customer_id", F.concat(pad, codes).alias("sequence"))


def feature_sequences(panel: DataFrame, labels: DataFrame, feature_cols: list[str], window: int) -> DataFrame:
    """F16: last ``window`` monthly rows per labelled customer, left zero-padded."""
    p = panel.join(labels.select("customer_id", "churn_label"), "customer_id")
    last = top_k_per_group(p, ["customer_id"], [F.desc("month")], window)
    vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    g = last.groupBy("customer_id", "churn_label").agg(
        F.array_sort(F.collect_list(F.struct("month", vec.alias("v")))).alias("s"))
    steps = F.transform("s", lambda x: x["v"])
    zero = F.array(*[F.lit(0.0) for _ in feature_cols])
    pad = F.array_repeat(zero, F.lit(window) - F.size(steps))
    return g.select("customer_id", "churn_label", F.concat(pad, steps).alias("sequence"))


def sequence_stats_table(seqs: DataFrame, n_features: int) -> DataFrame:
    """F17 statistics: per-feature mean and population std (+1e-8) over all steps."""
    steps = seqs.select(F.explode("sequence").alias("v"))
    aggs = []
    for i in range(n_features):
        aggs += [F.avg(F.col("v")[i]).alias(f"m{i}"), F.stddev_pop(F.col("v")[i]).alias(f"s{i}")]
    return steps.agg(*aggs)


def scale_sequences(seqs: DataFrame, n_features: int, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (std + 1e-8) per feature; all-zero (padding) steps stay 0."""
    st = stats if stats is not None else sequence_stats_table(seqs, n_features)
    j = seqs.crossJoin(F.broadcast(st))  # one row
    means = F.array(*[F.col(f"m{i}") for i in range(n_features)])
    stds = F.array(*[F.col(f"s{i}") + 1e-8 for i in range(n_features)])
    scaled = F.transform("sequence", lambda step: F.when(
        F.forall(step, lambda x: x == 0.0), step).otherwise(
        F.transform(step, lambda x, i: (x - means[i]) / stds[i])))
    return j.select(*[c for c in seqs.columns if c != "sequence"], scaled.alias("sequence"))


def pseudo_sequences(df: DataFrame, feature_cols: list[str], window: int) -> DataFrame:
    """standardised feature vector tiled ``window`` times, step t scaled by (t+1)/w."""
    st = df.agg(*[x for c in feature_cols
                  for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    j = df.crossJoin(F.broadcast(st))
    z = F.array(*[(F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8) for c in feature_cols])
    seq = F.transform(F.sequence(F.lit(1), F.lit(window)),
                      lambda t: F.transform(z, lambda x: x * t / window))
    return j.select("customer_id", seq.alias("sequence"))
