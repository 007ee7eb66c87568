"""Preparation and data-quality operators (Q1-Q20).

Every check is one aggregate pass over the table (conditional counts), returning rows
``(check, value, passed)`` rather than driver-side dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.config import MARKETING_RESPONSES
from churnlens.functions.prefix import global_order
from churnlens.functions.quantiles import grouped_quantiles


def _rows(names: list[str], *rows) -> Column:
    """Array of structs with the same field names (for explode into rows)."""
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, r)])
                     for r in rows])


def _num(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float", "integer", "long", "short") and f.name not in exclude]


# ------------------------------------------------------------------ Q1-Q6

def missing_profile(df: DataFrame) -> DataFrame:
    """Q1: null count per column (one aggregate, then unpivot)."""
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return agg.unpivot([], df.columns, "column", "missing_count")


def repair_missing(events: DataFrame) -> DataFrame:
    """Q2: drop null dates; timestamp <- date; null purchase amount <- median of non-null
    purchase amounts (0 if none); other null amounts <- 0."""
    e = events.filter(F.col("event_date").isNotNull())
    if "timestamp" in e.columns:
        e = e.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.col("event_date").cast("timestamp")))
    pur = e.filter((F.col("event_type") == "purchase") & F.col("amount").isNotNull()).select("amount")
    med = grouped_quantiles(pur, "amount", [0.5]).select(F.col("q").alias("__med"))
    med = med.unionByName(e.sparkSession.createDataFrame([(None,)], "__med double")).agg(
        F.coalesce(F.max("__med"), F.lit(0.0)).alias("__med"))
    out = e.crossJoin(F.broadcast(med))
    amt = F.when(F.col("amount").isNotNull(), F.col("amount")) \
        .when(F.col("event_type") == "purchase", F.col("__med")).otherwise(0.0)
    return out.withColumn("amount", amt).drop("__med")


def _fences(df: DataFrame, col: str) -> DataFrame:
    q = grouped_quantiles(df.select(col), col, [0.25, 0.75])
    f = q.agg(F.max(F.when(F.col("q_index") == 0, F.col("q"))).alias("__q1"),
              F.max(F.when(F.col("q_index") == 1, F.col("q"))).alias("__q3"))
    iqr = F.col("__q3") - F.col("__q1")
    return f.select((F.col("__q1") - 1.5 * iqr).alias("__lo"), (F.col("__q3") + 1.5 * iqr).alias("__hi"))


def flag_outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float = 3.0,
                  out_col: str = "is_outlier") -> DataFrame:
    """Q3 (IQR fences, linear quantiles) / Q4 (|z| > threshold, ddof=1); nulls are false."""
    x = F.col(col)
    if method == "zscore":
        st = df.agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s"))
        j = df.crossJoin(F.broadcast(st))
        flag = F.coalesce(F.abs((x - F.col("__m")) / F.when(F.col("__s") != 0, F.col("__s"))) > threshold,
                          F.lit(False))
        return j.withColumn(out_col, flag).drop("__m", "__s")
    j = df.crossJoin(F.broadcast(_fences(df, col)))
    flag = F.coalesce((x < F.col("__lo")) | (x > F.col("__hi")), F.lit(False))
    return j.withColumn(out_col, flag).drop("__lo", "__hi")


def cap_outliers(df: DataFrame, col: str) -> DataFrame:
    """Q5: clip to the IQR fences (row count unchanged)."""
    j = df.crossJoin(F.broadcast(_fences(df, col)))
    return j.withColumn(col, F.least(F.greatest(F.col(col), F.col("__lo")), F.col("__hi"))).drop("__lo", "__hi")


# ------------------------------------------------------------------ Q7-Q9

def time_split(customers: DataFrame, events: DataFrame, train: int = 10, test: int = 2):
    """Q7: split date = min + int(days * train / (train + test)); events <= / >; customers
    semi-joined on the ids of each side (a customer may be in both)."""
    span = events.agg(F.min("event_date").alias("__mn"), F.max("event_date").alias("__mx"))
    split = span.select(F.date_add("__mn", F.floor(F.datediff("__mx", "__mn") * train / (train + test))
                                   .cast("int")).alias("split_date"))
    e = events.crossJoin(F.broadcast(split))
    tr_e = e.filter(F.col("event_date") <= F.col("split_date")).drop("split_date")
    te_e = e.filter(F.col("event_date") > F.col("split_date")).drop("split_date")
    tr_c = customers.join(tr_e.select("customer_id"), "customer_id", "left_semi")
    te_c = customers.join(te_e.select("customer_id"), "customer_id", "left_semi")
    return (tr_c, tr_e), (te_c, te_e)


def positional_split(df: DataFrame, date_col: str, id_col: str = "customer_id", train: int = 8,
                     test: int = 2) -> DataFrame:
    """Q8: the first ``int(n * train / (train + test))`` rows by (date, id) are train."""
    n = df.count()
    k = int(n * train / (train + test))
    r = global_order(df, [(date_col, True), (id_col, True)], rank_col="__r")
    return r.withColumn("split", F.when(F.col("__r") <= k, "train").otherwise("test")).drop("__r")


def scale_features(df: DataFrame, cols: list[str] | None = None, method: str = "standard") -> DataFrame:
    """Q9: standard (population sd, ddof=0; 0 sd -> 1) or min-max (0 range -> 1)."""
    cols = cols or _num(df, ("customer_id",))
    if method == "minmax":
        st = df.agg(*[x for c in cols for x in (F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}"))])
        j = df.crossJoin(F.broadcast(st))
        for c in cols:
            rng = F.col(f"__b_{c}") - F.col(f"__a_{c}")
            j = j.withColumn(c, (F.col(c) - F.col(f"__a_{c}")) / F.when(rng == 0, 1.0).otherwise(rng))
    else:
        st = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__b_{c}"))])
        j = df.crossJoin(F.broadcast(st))
        for c in cols:
            sd = F.col(f"__b_{c}")
            j = j.withColumn(c, (F.col(c) - F.col(f"__a_{c}")) / F.when(sd == 0, 1.0).otherwise(sd))
    return j.drop(*[f"__a_{c}" for c in cols], *[f"__b_{c}" for c in cols])


# ------------------------------------------------------------------ Q10-Q12

def duplicate_keys(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Q10: keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def orphan_events(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Q11: events whose customer id is absent from customers."""
    return events.join(customers.select("customer_id"), "customer_id", "left_anti")


def bad_dates(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """Q12: non-null values that do not parse as a date."""
    s = F.col(col).cast("string")
    parsed = F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)
    return df.agg(F.count_if(s.isNotNull() & parsed.isNull()).alias("unparseable_dates"),
                  F.count(s).alias("non_null_values"))


# ------------------------------------------------------------------ Q13-Q15

def dataset_summary(customers: DataFrame, events: DataFrame) -> DataFrame:
    """Q13: ``(section, key, value)`` rows: counts, churn rate, treatment ratio, persona and
    event-type distributions (normalised shares)."""
    c = customers.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("churn_label").cast("double")).alias("churn"),
                      F.avg((F.col("treatment_group") == "treatment").cast("double")).alias("treat"))
    ne = events.agg(F.count(F.lit(1)).alias("ne"))
    head = c.crossJoin(ne).select(F.explode(_rows(
        ["section", "key", "value"],
        ("counts", "customers", F.col("n").cast("double")), ("counts", "events", F.col("ne").cast("double")),
        ("rates", "churn_rate", F.col("churn")), ("rates", "treatment_ratio", F.col("treat")))).alias("r")).select("r.*")
    per = (customers.groupBy("persona").agg(F.count(F.lit(1)).alias("k"))
           .crossJoin(F.broadcast(c.select("n")))
           .select(F.lit("persona_distribution").alias("section"), F.col("persona").alias("key"),
                   (F.col("k") / F.col("n")).alias("value")))
    et = (events.groupBy("event_type").agg(F.count(F.lit(1)).alias("k"))
          .select(F.lit("event_type_counts").alias("section"), F.col("event_type").alias("key"),
                  F.col("k").cast("double").alias("value")))
    return head.unionByName(per).unionByName(et)


def dataset_gates(customers: DataFrame, min_group: int = 100, churn_min: float = 0.05,
                  churn_max: float = 0.60) -> DataFrame:
    """Q14: minimum arm size and churn-rate range as pass / fail rows."""
    s = customers.agg(F.count_if(F.col("treatment_group") == "treatment").alias("nt"),
                      F.count_if(F.col("treatment_group") == "control").alias("nc"),
                      F.avg(F.col("churn_label").cast("double")).alias("cr"))
    return s.select(F.explode(_rows(
        ["gate", "value", "passed"],
        ("treatment_group_size", F.col("nt").cast("double"), F.col("nt") >= min_group),
        ("control_group_size", F.col("nc").cast("double"), F.col("nc") >= min_group),
        ("churn_rate_in_range", F.col("cr"), (F.col("cr") >= churn_min) & (F.col("cr") <= churn_max)))).alias("g")) \
        .select("g.*")


def event_metadata_check(customers: DataFrame, events: DataFrame,
                         allowed: tuple = MARKETING_RESPONSES) -> DataFrame:
    """Q15: session events have positive duration; responses are allowed and all present;
    every response has a channel. One row of checks."""
    r = F.col("marketing_response")
    s = events.agg(
        F.count_if(F.col("session_duration").isNotNull()).alias("session_events"),
        F.count_if(F.col("session_duration").isNotNull() & (F.col("session_duration") <= 0))
        .alias("non_positive_sessions"),
        F.count_if(r.isNotNull()).alias("response_events"),
        F.count_if(r.isNotNull() & ~r.isin(*allowed)).alias("invalid_responses"),
        F.count_if(r.isNotNull() & F.col("marketing_channel").isNull()).alias("responses_without_channel"),
        F.array_sort(F.collect_set(r)).alias("responses_observed"))
    return s.withColumn("sessions_positive", F.col("non_positive_sessions") == 0) \
        .withColumn("all_responses_present", F.size(F.array_except(F.array(*[F.lit(a) for a in allowed]),
                                                                   F.col("responses_observed"))) == 0) \
        .withColumn("responses_have_channel", F.col("responses_without_channel") == 0)


def persona_response_counts(customers: DataFrame, events: DataFrame) -> DataFrame:
    """Q15: persona x response counts."""
    e = events.filter(F.col("marketing_response").isNotNull()).select("customer_id", "marketing_response")
    return (e.join(customers.select("customer_id", "persona"), "customer_id")
            .groupBy("persona", "marketing_response").agg(F.count(F.lit(1)).alias("count")))


# ------------------------------------------------------------------ Q16-Q20

def prediction_coverage(pred: DataFrame, customers: DataFrame) -> DataFrame:
    """Q16: |predicted n customers|, missing, ratio, full-coverage flag."""
    p = pred.select("customer_id").distinct()
    c = customers.select("customer_id").distinct()
    covered = c.join(p, "customer_id", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    total = c.agg(F.count(F.lit(1)).alias("customers"))
    j = covered.crossJoin(total)
    return j.select("customers", "covered", (F.col("customers") - F.col("covered")).alias("missing"),
                    F.try_divide(F.col("covered"), F.col("customers")).alias("coverage_ratio"),
                    (F.col("covered") == F.col("customers")).alias("full_coverage"))


def clv_coverage(clv: DataFrame, customers: DataFrame, value_col: str = "clv") -> DataFrame:
    """Q17: null, negative, duplicate-id and missing-customer counts."""
    v = F.col(value_col)
    base = clv.agg(F.count_if(v.isNull()).alias("null_values"), F.count_if(v < 0).alias("negative_values"),
                   (F.count(F.lit(1)) - F.count_distinct("customer_id")).alias("duplicate_ids"))
    miss = customers.select("customer_id").join(clv.select("customer_id"), "customer_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("missing_customers"))
    return base.crossJoin(miss)


def check_result(df: DataFrame, name: str, key: str = "customer_id", required: list[str] | None = None,
                 ranges: dict[str, tuple] | None = None, customers: DataFrame | None = None) -> DataFrame:
    """Q18: contract checks as one aggregate: required columns, non-empty, unique key,
    one row per customer, value ranges."""
    required = required or []
    ranges = ranges or {}
    missing_cols = [c for c in required if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")]
    for c, (lo, hi) in ranges.items():
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (F.col(c) < lo)
        if hi is not None:
            cond = cond | (F.col(c) > hi)
        aggs.append(F.count_if(cond).alias(f"out_of_range_{c}"))
    s = df.agg(*aggs)
    checks = [("required_columns", F.lit(len(missing_cols) == 0), F.lit(",".join(missing_cols))),
              ("non_empty", F.col("rows") > 0, F.col("rows").cast("string")),
              ("unique_key", F.col("rows") == F.col("keys"), (F.col("rows") - F.col("keys")).cast("string"))]
    for c in ranges:
        checks.append((f"range_{c}", F.col(f"out_of_range_{c}") == 0, F.col(f"out_of_range_{c}").cast("string")))
    if customers is not None:
        s = s.crossJoin(customers.agg(F.count_distinct("customer_id").alias("__nc")))
        checks.append(("one_row_per_customer", F.col("keys") == F.col("__nc"), F.col("__nc").cast("string")))
    return s.select(F.lit(name).alias("table"), F.explode(_rows(["check", "passed", "detail"], *checks)).alias("c")) \
        .select("table", "c.*")


def check_outputs(recommendations: DataFrame, segments: DataFrame, milestones: DataFrame, min_segments: int = 6) -> DataFrame:
    """Q18: rules across results -- no active action for a customer without positive uplift or in a
    sleeping-dog segment, at least ``min_segments`` segments, each milestone known for some cohort."""
    alone = (F.col("uplift_score") <= 0) | F.coalesce(F.lower("segment").contains("sleeping_dog"), F.lit(False))
    a = recommendations.agg(F.count_if(alone & (F.col("action_type") != "no_action")).alias("active"))
    s = segments.agg(F.count_distinct("segment").alias("n_segments"))
    m = milestones.agg(F.least(*[F.count(f"M{k}") for k in (1, 3, 6, 12)]).alias("least"))
    return a.crossJoin(s).crossJoin(m).select(F.explode(_rows(
        ["check", "passed", "detail"],
        ("no_active_action_for_no_action_customers", F.col("active") == 0, F.col("active").cast("string")),
        ("enough_segments", F.col("n_segments") >= min_segments, F.col("n_segments").cast("string")),
        ("milestones_not_all_null", F.col("least") > 0, F.col("least").cast("string")))).alias("c")).select("c.*")


def check_cohort_outputs(ret: DataFrame, miles: DataFrame, sequences: DataFrame, funnel: DataFrame,
                         customers: DataFrame) -> DataFrame:
    """Q19: >= 2 periods, each milestone M1/M3/M6/M12 not all null, >= 5 sequences whose counts
    sum to >= 6, funnel Signup count = customers."""
    a = ret.agg(F.count_distinct("cohort_period").alias("periods"))
    m = miles.agg(*[F.count(f"M{k}").alias(f"m{k}") for k in (1, 3, 6, 12)])
    s = sequences.agg(F.count(F.lit(1)).alias("n_seq"), F.coalesce(F.sum("count"), F.lit(0)).alias("seq_total"))
    f = funnel.filter(F.col("stage") == "Signup").agg(F.max("count").alias("signup"))
    c = customers.agg(F.count(F.lit(1)).alias("n_customers"))
    j = a.crossJoin(m).crossJoin(s).crossJoin(f).crossJoin(c)
    return j.select(F.explode(_rows(
        ["check", "passed"],
        ("at_least_two_periods", F.col("periods") >= 2),
        ("milestones_not_all_null", F.least("m1", "m3", "m6", "m12") > 0),
        ("at_least_five_sequences", F.col("n_seq") >= 5),
        ("sequence_counts_at_least_six", F.col("seq_total") >= 6),
        ("funnel_signup_equals_customers", F.col("signup") == F.col("n_customers")))).alias("c")).select("c.*")


def features_match(features: DataFrame, customers: DataFrame) -> DataFrame:
    """Q20: ids only on one side and label mismatches (full outer join)."""
    j = features.select("customer_id", F.col("churn_label").alias("fl")).join(
        customers.select("customer_id", F.col("churn_label").alias("cl")), "customer_id", "full")
    return j.agg(F.count_if(F.col("cl").isNull()).alias("only_in_features"),
                 F.count_if(F.col("fl").isNull() & F.col("cl").isNotNull()).alias("only_in_customers"),
                 F.count_if(F.col("fl").isNotNull() & F.col("cl").isNotNull() & (F.col("fl") != F.col("cl")))
                 .alias("label_mismatches")) \
        .withColumn("features_current", (F.col("only_in_features") + F.col("only_in_customers")
                                         + F.col("label_mismatches")) == 0)
