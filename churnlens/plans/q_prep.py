"""Queries: sources and projections (S1-S10), preparation and data quality (Q1-Q20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlens.operators import features as fe
from churnlens.operators import prep as pp
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.plans.q_features import LABEL_PARAMS, LAB2, LABEL_SQL_CTE, REF
from churnlens.plans.q_segment import RFM_CTE
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources import io
from churnlens.sources import tables as tb

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ACT_COLS = ["event_id", "customer_id", "event_type", "event_date", "timestamp", "amount", "session_duration",
            "marketing_channel", "marketing_response"]


# ---------------------------------------------------------------- sources

@register("normalize_events", oracle("SELECT customer_id, event_date, event_type FROM activity", views=["activity"]))
def q_normalize_events(spark, sf):
    """Alias resolution to (customer_id, event_date, event_type)."""
    return io.normalize_events(tb.activity_events(spark, sf))


@register("prepare_events", oracle("""SELECT customer_id, event_type, event_date, "timestamp", amount, session_duration
  FROM activity""", views=["activity"], doubles=["amount", "session_duration"]))
def q_prepare_events(spark, sf):
    """Feature-input projection with coercion."""
    return io.prepare_events(tb.activity_events(spark, sf))


@register("feature_store_roundtrip", oracle("SELECT * FROM rfm", views=["cust"], ctes=[RFM_CTE],
                                            doubles=["recency", "monetary", "avg_order_value", "monetary_per_day"]))
def q_feature_store(spark, sf):
    """Write the RFM table to the shared checkpoint folder as Parquet and read it back."""
    from churnlens.plans.q_segment import _rfm
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tag = sf.rstrip("/").split("/")[-1]
    path = io.save_feature_store(_rfm(spark, sf), f"{base}/feature_store/rfm_{tag}")
    return io.load_feature_store(spark, path)


@register("cohort_purchases", oracle("""SELECT customer_id, event_date, amount AS revenue, 'all' AS segment
  FROM activity WHERE amount > 0""", views=["activity"], doubles=["revenue"]))
def q_cohort_purchases(spark, sf):
    """Purchase projection for cohorts."""
    return io.cohort_purchases(tb.activity_events(spark, sf))


@register("filter_to_cutoff", oracle(f"""SELECT a.* FROM activity a
  WHERE event_date <= (SELECT ref_date - {max(LABEL_PARAMS.no_purchase_days, LABEL_PARAMS.no_login_days)} FROM aref)""",
    views=["activity"], ctes=[REF], doubles=["amount", "session_duration"]))
def q_filter_to_cutoff(spark, sf):
    """Events up to the observation cutoff T = end - max(no-purchase, no-login) days."""
    ev = tb.activity_events(spark, sf)
    t = io.observation_cutoff(fe.max_date_plus(ev, 1), LABEL_PARAMS.no_purchase_days, LABEL_PARAMS.no_login_days)
    return io.filter_to_cutoff(ev, t)


# ---------------------------------------------------------------- Q1-Q6

@register("missing_profile", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing_count FROM orders" for c in ORDER_COLS), views=[]))
def q_missing_profile(spark, sf):
    """Q1: null count per column of orders."""
    return pp.missing_profile(tb.read_table(spark, sf, "orders"))


@register("repair_missing", oracle("""
SELECT event_id, customer_id, event_type, event_date, coalesce("timestamp", CAST(event_date AS TIMESTAMP)) AS "timestamp",
  CASE WHEN amount IS NOT NULL THEN amount WHEN event_type = 'purchase' THEN
    coalesce((SELECT median(amount) FROM activity WHERE event_type = 'purchase' AND amount IS NOT NULL
              AND event_date IS NOT NULL), 0.0) ELSE 0.0 END AS amount,
  session_duration, marketing_channel, marketing_response
FROM activity WHERE event_date IS NOT NULL""", views=["activity"], doubles=["amount", "session_duration"]))
def q_repair_missing(spark, sf):
    """Q2: missing-value repair (median purchase amount)."""
    return pp.repair_missing(tb.activity_events(spark, sf))


FENCE = """f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders))"""


@register("flag_outliers_iqr", oracle("""SELECT o_orderkey, o_totalprice,
  coalesce(o_totalprice < lo OR o_totalprice > hi, false) AS is_outlier FROM orders CROSS JOIN f""",
    views=[], ctes=[FENCE], doubles=["o_totalprice"]))
def q_flag_iqr(spark, sf):
    """Q3: IQR outlier flag on order totals."""
    o = tb.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return pp.flag_outliers(o, "o_totalprice", "iqr")


@register("flag_outliers_zscore", oracle("""SELECT o_orderkey, o_totalprice,
  coalesce(abs((o_totalprice - m) / nullif(s, 0)) > 3.0, false) AS is_outlier
FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)""",
    views=[], doubles=["o_totalprice"]))
def q_flag_zscore(spark, sf):
    """Q4: z-score outlier flag (ddof=1, |z| > 3)."""
    o = tb.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return pp.flag_outliers(o, "o_totalprice", "zscore", 3.0)


@register("cap_outliers", oracle("""SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS o_totalprice
  FROM orders CROSS JOIN f""", views=[], ctes=[FENCE], doubles=["o_totalprice"]))
def q_cap_outliers(spark, sf):
    """Q5: clip order totals to the IQR fences."""
    o = tb.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return pp.cap_outliers(o, "o_totalprice")


# ---------------------------------------------------------------- Q7-Q12

@register("time_split", oracle("""
SELECT side, count(*) AS n_events, count(DISTINCT customer_id) AS n_customers FROM e
WHERE customer_id IN (SELECT customer_id FROM cust) GROUP BY side""", views=["cust", "activity"], ctes=[
    """sp AS (SELECT mn + CAST(floor(date_diff('day', mn, mx) * 10 / 12) AS INTEGER) AS split_date
            FROM (SELECT min(event_date) AS mn, max(event_date) AS mx FROM activity))""",
    """e AS (SELECT a.*, CASE WHEN a.event_date <= sp.split_date THEN 'train' ELSE 'test' END AS side
      FROM activity a CROSS JOIN sp WHERE a.event_date IS NOT NULL)"""]))
def q_time_split(spark, sf):
    """Q7: time split by span fraction 10:2; event and customer counts per side."""
    (trc, tre), (tec, tee) = pp.time_split(tb.customers(spark, sf), tb.activity_events(spark, sf), 10, 2)

    def side(c, e, name):
        ne = e.join(c.select("customer_id"), "customer_id", "left_semi").agg(F.count(F.lit(1)).alias("n_events"))
        return ne.crossJoin(c.agg(F.count(F.lit(1)).alias("n_customers"))).select(
            F.lit(name).alias("side"), "n_events", "n_customers")
    return side(trc, tre, "train").unionByName(side(tec, tee, "test"))


@register("positional_split", oracle("""
SELECT customer_id, signup_date, CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS split
FROM (SELECT customer_id, signup_date, row_number() OVER (ORDER BY signup_date, customer_id) AS rn
      FROM cust WHERE signup_date IS NOT NULL)
CROSS JOIN (SELECT CAST(floor(count(*) * 8 / 10) AS BIGINT) AS k FROM cust WHERE signup_date IS NOT NULL)""",
    views=["cust"]))
def q_positional_split(spark, sf):
    """Q8: first 80% of customers by (signup date, id) are train (distributed global rank)."""
    c = tb.customers(spark, sf).filter(F.col("signup_date").isNotNull()).select("customer_id", "signup_date")
    return pp.positional_split(c, "signup_date", "customer_id", 8, 2)


SCALE_COLS = ["recency", "frequency", "monetary"]


@register("scale_standard", oracle("SELECT customer_id, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM rfm)) / coalesce(nullif((SELECT stddev_pop({c}) FROM rfm), 0), 1.0) AS {c}"
    for c in SCALE_COLS) + " FROM rfm", views=["cust"], ctes=[RFM_CTE], doubles=SCALE_COLS))
def q_scale_standard(spark, sf):
    """Q9: standard scaling (population sd) of RFM columns."""
    from churnlens.plans.q_segment import _rfm
    return pp.scale_features(_rfm(spark, sf).select("customer_id", *SCALE_COLS), SCALE_COLS, "standard")


@register("scale_minmax", oracle("SELECT customer_id, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM rfm)) / coalesce(nullif((SELECT max({c}) - min({c}) FROM rfm), 0), 1.0) AS {c}"
    for c in SCALE_COLS) + " FROM rfm", views=["cust"], ctes=[RFM_CTE], doubles=SCALE_COLS))
def q_scale_minmax(spark, sf):
    """Q9: min-max scaling of RFM columns."""
    from churnlens.plans.q_segment import _rfm
    return pp.scale_features(_rfm(spark, sf).select("customer_id", *SCALE_COLS), SCALE_COLS, "minmax")


@register("duplicate_keys", oracle("""SELECT o_custkey AS customer_id, count(*) AS count FROM orders
  GROUP BY o_custkey HAVING count(*) > 1""", views=[]))
def q_duplicate_keys(spark, sf):
    """Q10: customer ids with more than one order row."""
    o = tb.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"))
    return pp.duplicate_keys(o, "customer_id")


@register("orphan_events", oracle("""SELECT * FROM activity WHERE customer_id NOT IN (SELECT customer_id FROM cust)""",
                                  views=["cust", "activity"], doubles=["amount", "session_duration"]))
def q_orphan_events(spark, sf):
    """Q11: events whose customer is unknown."""
    return pp.orphan_events(tb.activity_events(spark, sf), tb.customers(spark, sf))


@register("bad_dates", oracle("""
SELECT 'o_orderdate' AS "column", count_if(v IS NOT NULL AND TRY_CAST(v AS TIMESTAMP) IS NULL) AS unparseable_dates,
  count(v) AS non_null_values FROM (SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS v FROM orders)
UNION ALL
SELECT 'o_orderstatus', count_if(o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS TIMESTAMP) IS NULL),
  count(o_orderstatus) FROM orders""", views=[]))
def q_bad_dates(spark, sf):
    """Q12: unparseable date strings (a date column and a non-date column)."""
    o = tb.read_table(spark, sf, "orders")
    a = pp.bad_dates(o.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("v")), "v")
    b = pp.bad_dates(o.select(F.col("o_orderstatus").alias("v")), "v")
    return (a.select(F.lit("o_orderdate").alias("column"), "*")
            .unionByName(b.select(F.lit("o_orderstatus").alias("column"), "*")))


# ---------------------------------------------------------------- Q13-Q20

@register("dataset_summary", oracle("""
SELECT 'counts' AS section, 'customers' AS key, CAST(count(*) AS DOUBLE) AS value FROM cust
UNION ALL SELECT 'counts', 'events', CAST(count(*) AS DOUBLE) FROM activity
UNION ALL SELECT 'rates', 'churn_rate', avg(CAST(churn_label AS DOUBLE)) FROM cust
UNION ALL SELECT 'rates', 'treatment_ratio', avg(CAST(treatment_group = 'treatment' AS DOUBLE)) FROM cust
UNION ALL SELECT 'persona_distribution', persona, count(*) / (SELECT count(*) FROM cust) FROM cust GROUP BY persona
UNION ALL SELECT 'event_type_counts', event_type, CAST(count(*) AS DOUBLE) FROM activity GROUP BY event_type""",
    views=["cust", "activity"], doubles=["value"]))
def q_dataset_summary(spark, sf):
    """Q13: dataset summary rows."""
    return pp.dataset_summary(tb.customers(spark, sf), tb.activity_events(spark, sf))


@register("dataset_gates", oracle("""
SELECT 'treatment_group_size' AS gate, CAST(count_if(treatment_group = 'treatment') AS DOUBLE) AS value,
  count_if(treatment_group = 'treatment') >= 100 AS passed FROM cust
UNION ALL SELECT 'control_group_size', CAST(count_if(treatment_group = 'control') AS DOUBLE),
  count_if(treatment_group = 'control') >= 100 FROM cust
UNION ALL SELECT 'churn_rate_in_range', avg(CAST(churn_label AS DOUBLE)),
  avg(CAST(churn_label AS DOUBLE)) BETWEEN 0.05 AND 0.60 FROM cust""", views=["cust"], doubles=["value"]))
def q_dataset_gates(spark, sf):
    """Q14: arm-size and churn-rate gates."""
    return pp.dataset_gates(tb.customers(spark, sf))


@register("event_metadata_check", oracle("""
SELECT count_if(session_duration IS NOT NULL) AS session_events,
  count_if(session_duration IS NOT NULL AND session_duration <= 0) AS non_positive_sessions,
  count_if(marketing_response IS NOT NULL) AS response_events,
  count_if(marketing_response IS NOT NULL AND marketing_response NOT IN ('adverse', 'conversion', 'no_response'))
    AS invalid_responses,
  count_if(marketing_response IS NOT NULL AND marketing_channel IS NULL) AS responses_without_channel,
  list_sort(list_distinct(list(marketing_response))) AS responses_observed,
  count_if(session_duration IS NOT NULL AND session_duration <= 0) = 0 AS sessions_positive,
  len(list_filter(['adverse', 'conversion', 'no_response'],
                  lambda x: NOT list_contains(list_distinct(list(marketing_response)), x))) = 0 AS all_responses_present,
  count_if(marketing_response IS NOT NULL AND marketing_channel IS NULL) = 0 AS responses_have_channel
FROM activity""", views=["activity"]))
def q_event_metadata_check(spark, sf):
    """Q15: event metadata checks."""
    return pp.event_metadata_check(tb.customers(spark, sf), tb.activity_events(spark, sf))


@register("persona_response_counts", oracle("""SELECT c.persona, a.marketing_response, count(*) AS count
  FROM activity a JOIN cust c ON a.customer_id = c.customer_id WHERE a.marketing_response IS NOT NULL
  GROUP BY c.persona, a.marketing_response""", views=["cust", "activity"]))
def q_persona_response(spark, sf):
    """Q15: persona x marketing response counts."""
    return pp.persona_response_counts(tb.customers(spark, sf), tb.activity_events(spark, sf))


@register("prediction_coverage", oracle("""
SELECT customers, covered, customers - covered AS missing, covered / customers AS coverage_ratio,
  covered = customers AS full_coverage
FROM (SELECT count(*) AS customers, count_if(customer_id IN (SELECT customer_id FROM purchases)) AS covered FROM cust)""",
    views=["cust"], doubles=["coverage_ratio"]))
def q_prediction_coverage(spark, sf):
    """Q16: customers covered by the purchase-based (RFM) predictions."""
    return pp.prediction_coverage(tb.purchases(spark, sf), tb.customers(spark, sf))


@register("clv_coverage", oracle("""
SELECT count_if(clv IS NULL) AS null_values, count_if(clv < 0) AS negative_values,
  count(*) - count(DISTINCT customer_id) AS duplicate_ids,
  (SELECT count(*) FROM cust WHERE customer_id NOT IN (SELECT customer_id FROM purchases)) AS missing_customers
FROM (SELECT customer_id, sum(amount) / 10.0 AS clv FROM purchases GROUP BY customer_id)""", views=["cust"]))
def q_clv_coverage(spark, sf):
    """Q17: CLV coverage counts of customers with purchases."""
    clv = tb.purchases(spark, sf).groupBy("customer_id").agg((F.sum("amount") / 10.0).alias("clv"))
    return pp.clv_coverage(clv, tb.customers(spark, sf))


@register("check_result", oracle("""
SELECT 'scores' AS "table", c.* FROM (SELECT unnest([
  {'check': 'required_columns', 'passed': true, 'detail': ''},
  {'check': 'non_empty', 'passed': count(*) > 0, 'detail': CAST(count(*) AS VARCHAR)},
  {'check': 'unique_key', 'passed': count(*) = count(DISTINCT customer_id),
   'detail': CAST(count(*) - count(DISTINCT customer_id) AS VARCHAR)},
  {'check': 'range_churn_probability', 'passed': count_if(churn_probability < 0 OR churn_probability > 1) = 0,
   'detail': CAST(count_if(churn_probability < 0 OR churn_probability > 1) AS VARCHAR)},
  {'check': 'range_uplift_score', 'passed': count_if(uplift_score < -1 OR uplift_score > 1) = 0,
   'detail': CAST(count_if(uplift_score < -1 OR uplift_score > 1) AS VARCHAR)},
  {'check': 'one_row_per_customer', 'passed': count(DISTINCT customer_id) = (SELECT count(DISTINCT customer_id) FROM cust),
   'detail': CAST((SELECT count(DISTINCT customer_id) FROM cust) AS VARCHAR)}]) AS c FROM scores) AS t""",
    views=["cust", "scores"]))
def q_check_result(spark, sf):
    """Q18: result contract checks on the score table."""
    return pp.check_result(tb.scores(spark, sf), "scores", "customer_id",
                           ["customer_id", "churn_probability", "clv"],
                           {"churn_probability": (0, 1), "uplift_score": (-1, 1)}, tb.customers(spark, sf))


def _check_outputs_sql() -> str:
    from churnlens.plans import q_cohort, q_recommend, q_segment  # noqa: F401 (their SQL)
    from churnlens.plans.catalog import ORACLE
    return f"""WITH r AS ({ORACLE["recommendations"]}), g AS ({ORACLE["rfm_segments"]}), m AS ({ORACLE["retention_milestones"]}),
n AS (SELECT (SELECT count_if((uplift_score <= 0 OR contains(lower(segment), 'sleeping_dog')) AND action_type <> 'no_action') FROM r) AS a,
    (SELECT count(DISTINCT segment) FROM g) AS s, (SELECT least(count(M1), count(M3), count(M6), count(M12)) FROM m) AS l)
SELECT 'no_active_action_for_no_action_customers' AS "check", a = 0 AS passed, CAST(a AS VARCHAR) AS detail FROM n
UNION ALL SELECT 'enough_segments', s >= 6, CAST(s AS VARCHAR) FROM n
UNION ALL SELECT 'milestones_not_all_null', l > 0, CAST(l AS VARCHAR) FROM n"""


@register("check_outputs", _check_outputs_sql())
def q_check_outputs(spark, sf):
    """Q18: rules across recommendations, segments and milestones."""
    from churnlens.operators import cohort as co
    from churnlens.operators import recommend as rc
    from churnlens.operators import segment as sg
    from churnlens.plans.q_cohort import P, _monthly
    from churnlens.plans.q_recommend import _input
    from churnlens.plans.q_segment import _rfm
    ret = co.retention(_monthly(spark, sf), P)
    return pp.check_outputs(rc.recommend(_input(spark, sf)), sg.rfm_segments(_rfm(spark, sf)),
                            co.milestones(ret, P.milestones))


def _check_cohorts_sql() -> str:
    from churnlens.plans import q_cohort  # noqa: F401 (its SQL)
    from churnlens.plans.catalog import ORACLE
    return f"""WITH r AS ({ORACLE["retention"]}), m AS ({ORACLE["retention_milestones"]}), s AS ({ORACLE["churn_sequences"]}),
f AS ({ORACLE["journey_funnel"]}),
n AS (SELECT (SELECT count(DISTINCT cohort_period) FROM r) AS p, (SELECT least(count(M1), count(M3), count(M6), count(M12)) FROM m) AS l,
    (SELECT count(*) FROM s) AS q, (SELECT coalesce(sum("count"), 0) FROM s) AS t, (SELECT max("count") FROM f WHERE stage = 'Signup') AS u,
    (SELECT count(*) FROM customer) AS c)
SELECT 'at_least_two_periods' AS "check", p >= 2 AS passed FROM n UNION ALL SELECT 'milestones_not_all_null', l > 0 FROM n
UNION ALL SELECT 'at_least_five_sequences', q >= 5 FROM n UNION ALL SELECT 'sequence_counts_at_least_six', t >= 6 FROM n
UNION ALL SELECT 'funnel_signup_equals_customers', u = c FROM n"""


@register("check_cohort_outputs", _check_cohorts_sql())
def q_check_cohort_outputs(spark, sf):
    """Q19: cohort output consistency checks (composite of C6, C14, C17, C19)."""
    from churnlens.operators import cohort as co
    from churnlens.plans.q_cohort import P, SEQ_DAYS, _monthly
    cust = tb.customers(spark, sf)
    ret = co.retention(_monthly(spark, sf), P)
    return pp.check_cohort_outputs(ret, co.milestones(ret, P.milestones),
                                   co.churn_sequences(tb.activity_events(spark, sf), cust, SEQ_DAYS, 5),
                                   co.journey_funnel(cust, tb.purchases(spark, sf)), cust)


@register("features_match", oracle("""
SELECT count_if(c.customer_id IS NULL) AS only_in_features,
  count_if(f.customer_id IS NULL AND c.customer_id IS NOT NULL) AS only_in_customers,
  count_if(f.customer_id IS NOT NULL AND c.customer_id IS NOT NULL AND f.churn_label <> c.churn_label) AS label_mismatches,
  count_if(c.customer_id IS NULL) + count_if(f.customer_id IS NULL AND c.customer_id IS NOT NULL)
    + count_if(f.customer_id IS NOT NULL AND c.customer_id IS NOT NULL AND f.churn_label <> c.churn_label) = 0
    AS features_current
FROM lab2 f FULL JOIN cust c ON f.customer_id = c.customer_id""", views=["cust", "activity"],
    ctes=[REF, LABEL_SQL_CTE, LAB2]))
def q_features_match(spark, sf):
    """Q20: stale-feature check -- activity labels vs the customer table's labels."""
    cust, ev = tb.customers(spark, sf), tb.activity_events(spark, sf)
    lab = fe.label_churn(cust, ev, fe.max_date_plus(ev, 1), LABEL_PARAMS)
    return pp.features_match(lab, cust)


# ---------------------------------------------------------------- S1-S3, S7 scans and sinks

def _shared(spark, sf, name):
    """A path in the shared folder named by ``spark.checkpoint.dir`` (never machine-local
    on a cluster), one per call."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sources/{name}_{sf.rstrip('/').split('/')[-1]}-{uuid.uuid4().hex}"


@register("customer_scan", oracle("SELECT * FROM customer", views=[], doubles=["c_acctbal"]))
def q_customer_scan(spark, sf):
    """Customer table scan, Parquet preferred over CSV, signup date parsed when present."""
    return io.load_customers(spark, f"{sf.rstrip('/')}/customer")


@register("event_scan", oracle("""SELECT customer_id, event_type, event_date, "timestamp", amount, session_duration,
  marketing_channel, marketing_response FROM activity""", views=["activity"], doubles=["amount", "session_duration"]))
def q_event_scan(spark, sf):
    """The domain events stored as Parquet (with an extra id column) scanned back with
    only the 8 event columns, dates parsed and numbers coerced."""
    path = _shared(spark, sf, "events")
    tb.activity_events(spark, sf).write.mode("overwrite").parquet(path + ".parquet")
    return io.load_events(spark, path)


@register("csv_scan", oracle("""SELECT CAST(customer_id AS VARCHAR) AS customer_id, persona, signup_date,
  treatment_group, churn_label FROM cust""", views=["cust"], ints=["churn_label"]))
def q_csv_scan(spark, sf):
    """S3: customers written as CSV and read back with an explicit schema and date parsing."""
    path = _shared(spark, sf, "customers_csv")
    (tb.customers(spark, sf).select("customer_id", "persona", F.col("signup_date").cast("string"),
                                    "treatment_group", "churn_label")
     .write.mode("overwrite").option("header", True).csv(path))
    return io.read_csv_typed(spark, path, io.CUSTOMER_SCHEMA, date_cols=["signup_date"])


def _summary_sql():
    from churnlens.plans.q_segment import SUMMARY_SQL
    return SUMMARY_SQL


@register("result_sink", _summary_sql())
def q_result_sink(spark, sf):
    """The segment summary written as JSON lines and read back with its schema."""
    from churnlens.operators import segment as sg
    from churnlens.plans.q_segment import _rfm
    res = sg.segment_summary(sg.rfm_segments(_rfm(spark, sf)))
    path = io.save_result(res, _shared(spark, sf, "segment_summary_json"), fmt="json")
    return spark.read.schema(res.schema).json(path)
