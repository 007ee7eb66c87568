"""Queries: cohorts, retention, journeys (C1-C22) on orders as purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.config import CohortParams
from churnlens.operators import cohort as co
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.sources import tables as tb

P = CohortParams()
SEQ_DAYS = 2      # events span 30 days: a short pre-churn window keeps sequences comparable


def _purchases_with_signup(spark, sf):
    cust = tb.customers(spark, sf).select("customer_id", "signup_date")
    return (tb.purchases(spark, sf).join(cust, "customer_id")
            .withColumnRenamed("amount", "revenue"))


def _monthly(spark, sf):
    return co.assign_cohorts(_purchases_with_signup(spark, sf), "monthly")


COH = """coh AS (SELECT p.customer_id, p.order_id, p.event_type, p.event_date, p.amount AS revenue, c.signup_date,
    strftime(c.signup_date, '%Y-%m') AS cohort,
    CAST(greatest(floor(date_diff('day', c.signup_date, p.event_date) / 30), 0) AS INTEGER) AS cohort_period
  FROM purchases p JOIN cust c ON p.customer_id = c.customer_id)"""
RET = f"""cnt AS (SELECT cohort, cohort_period, count(DISTINCT customer_id) AS customers FROM coh
  WHERE cohort_period <= {P.max_periods} GROUP BY cohort, cohort_period),
dense AS (SELECT g.cohort, g.cohort_period, coalesce(n.customers, 0) AS customers
  FROM (SELECT c.cohort, p.cohort_period FROM (SELECT DISTINCT cohort FROM cnt) c
        CROSS JOIN (SELECT DISTINCT cohort_period FROM cnt) p) g
  LEFT JOIN cnt n ON g.cohort = n.cohort AND g.cohort_period = n.cohort_period),
based AS (SELECT *, max(CASE WHEN cohort_period = 0 THEN customers END) OVER (PARTITION BY cohort) AS base FROM dense),
ret AS (SELECT cohort, cohort_period, customers,
    min(customers / base) OVER (PARTITION BY cohort ORDER BY cohort_period
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS retention
  FROM based WHERE base >= {P.min_cohort_size})"""
V = ["cust"]


@register("monthly_cohorts", oracle("SELECT * FROM coh", views=V, ctes=[COH], doubles=["revenue"],
                                    ints=["cohort_period"]))
def q_monthly_cohorts(spark, sf):
    """Signup-month cohorts, 30-day periods clipped at 0."""
    return _monthly(spark, sf).select("customer_id", "order_id", "event_type", "event_date", "revenue",
                                      "signup_date", "cohort", "cohort_period")


@register("weekly_cohorts", oracle("""
SELECT p.customer_id, p.order_id, p.event_date,
  CAST(isoyear(c.signup_date) AS VARCHAR) || '-W' || lpad(CAST(week(c.signup_date) AS VARCHAR), 2, '0') AS cohort,
  CAST(floor(date_diff('day', c.signup_date, p.event_date) / 7) AS BIGINT) AS cohort_period
FROM purchases p JOIN cust c ON p.customer_id = c.customer_id""", views=V))
def q_weekly_cohorts(spark, sf):
    """ISO-week cohorts, 7-day periods."""
    return co.assign_cohorts(_purchases_with_signup(spark, sf), "weekly").select(
        "customer_id", "order_id", "event_date", "cohort", "cohort_period")


@register("behavioral_cohorts", oracle("""
SELECT p.customer_id, p.order_id, p.event_date, f.cohort,
  (year(p.event_date) * 12 + month(p.event_date)) - (year(m.first) * 12 + month(m.first)) AS cohort_period
FROM purchases p
JOIN (SELECT customer_id, arg_min(o_orderpriority, (event_date, order_id)) AS cohort
      FROM purchases JOIN orders ON order_id = o_orderkey GROUP BY customer_id) f ON p.customer_id = f.customer_id
JOIN (SELECT customer_id, min(event_date) AS first FROM purchases GROUP BY customer_id) m
  ON p.customer_id = m.customer_id""", views=["purchases"], ints=["cohort_period"]))
def q_behavioral_cohorts(spark, sf):
    """cohort = order priority of the customer's first order; period = month difference."""
    pur = tb.purchases(spark, sf)
    pri = tb.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderpriority")
    df = pur.join(pri, "order_id").drop("signup_date")
    out = co.assign_cohorts(df, "behavioral", behavior_col="o_orderpriority", signup_col=None,
                            order_col="order_id")
    return out.select("customer_id", "order_id", "event_date", "cohort", "cohort_period")


@register("compact_cohorts", oracle("""
SELECT DISTINCT * FROM (
  SELECT customer_id, strftime(signup_date, '%Y-%m') AS cohort, 0 AS cohort_period FROM cust WHERE signup_date IS NOT NULL
  UNION ALL
  SELECT p.customer_id, strftime(c.signup_date, '%Y-%m'),
         greatest(floor(date_diff('day', c.signup_date, p.event_date) / 30), 0)
  FROM purchases p JOIN cust c ON p.customer_id = c.customer_id WHERE c.signup_date IS NOT NULL)""",
    views=V, ints=["cohort_period"]))
def q_compact_cohorts(spark, sf):
    """C4: distinct (customer, cohort, period) frame with a period-0 row per customer."""
    return co.compact_cohorts(tb.purchases(spark, sf), tb.customers(spark, sf), "monthly")


@register("cohort_labels", oracle("""SELECT customer_id, signup_date, strftime(signup_date, '%Y-%m') AS cohort
  FROM cust WHERE signup_date IS NOT NULL""", views=V))
def q_cohort_labels(spark, sf):
    """Monthly cohort label of the signup date."""
    c = tb.customers(spark, sf).select("customer_id", "signup_date")
    return co.cohort_label(c, "signup_date", "monthly")


@register("retention", oracle("SELECT * FROM ret", views=V, ctes=[COH, RET], doubles=["retention"]))
def q_retention(spark, sf):
    """Retention matrix (long form), densified, size-filtered, running minimum."""
    return co.retention(_monthly(spark, sf), P)


@register("cohort_metrics", oracle(f"""
SELECT g.cohort, g.cohort_period, coalesce(m.customer_count, 0) AS customer_count,
       coalesce(m.revenue, 0.0) AS revenue, coalesce(m.avg_order_value, 0.0) AS avg_order_value
FROM (SELECT c.cohort, p.cohort_period FROM (SELECT DISTINCT cohort FROM m0) c
      CROSS JOIN (SELECT DISTINCT cohort_period FROM m0) p) g
LEFT JOIN m0 m ON g.cohort = m.cohort AND g.cohort_period = m.cohort_period""", views=V, ctes=[COH, f"""m0 AS (
  SELECT cohort, cohort_period, count(DISTINCT customer_id) AS customer_count, sum(revenue) AS revenue,
         avg(revenue) AS avg_order_value FROM coh WHERE cohort_period <= {P.max_periods} GROUP BY cohort, cohort_period)"""],
    doubles=["revenue", "avg_order_value"]))
def q_cohort_metrics(spark, sf):
    """Customer count, revenue and mean order value per cohort and period."""
    return co.cohort_metrics(_monthly(spark, sf), P.max_periods)


@register("cohort_churn", oracle("SELECT cohort, cohort_period, 1.0 - retention AS churn_rate FROM ret",
                                 views=V, ctes=[COH, RET], doubles=["churn_rate"]))
def q_cohort_churn(spark, sf):
    """Churn metric = 1 - retention."""
    return co.churn_matrix(co.retention(_monthly(spark, sf), P))


@register("cohort_summary", oracle("""
SELECT cohort, count(DISTINCT customer_id) AS total_customers, count(cohort_period) AS total_events,
  max(cohort_period) AS max_period, sum(revenue) AS total_revenue,
  (SELECT avg(mp) FROM (SELECT max(cohort_period) AS mp FROM coh c2 WHERE c2.cohort = coh.cohort
                        GROUP BY customer_id)) AS avg_lifetime_periods
FROM coh GROUP BY cohort""", views=V, ctes=[COH], doubles=["total_revenue", "avg_lifetime_periods"],
    ints=["max_period"]))
def q_cohort_summary(spark, sf):
    """Per-cohort summary."""
    return co.cohort_summary(_monthly(spark, sf))


@register("filter_cohorts", oracle(f"""
SELECT customer_id, order_id, cohort, cohort_period FROM coh
WHERE cohort IN (SELECT cohort FROM coh GROUP BY cohort HAVING count(DISTINCT customer_id) >= {P.min_cohort_size})""",
    views=V, ctes=[COH], ints=["cohort_period"]))
def q_filter_cohorts(spark, sf):
    """Cohorts with at least the minimum number of customers."""
    return co.filter_cohorts(_monthly(spark, sf), None, P.min_cohort_size).select(
        "customer_id", "order_id", "cohort", "cohort_period")


@register("retention_curves", oracle("""
SELECT cohort, list((round(retention, 6) + 0.0) ORDER BY cohort_period) AS curve FROM ret GROUP BY cohort""",
    views=V, ctes=[COH, RET]))
def q_retention_curves(spark, sf):
    """Retention curve per cohort."""
    return co.retention_curves(co.retention(_monthly(spark, sf), P))


@register("average_retention_curve", oracle("SELECT cohort_period, avg(retention) AS avg_retention FROM ret "
                                            "GROUP BY cohort_period", views=V, ctes=[COH, RET],
                                            doubles=["avg_retention"], ints=["cohort_period"]))
def q_average_curve(spark, sf):
    """C11: mean retention per period."""
    return co.average_curve(co.retention(_monthly(spark, sf), P))


HALF = """hl AS (SELECT cohort, min(CASE WHEN retention < 0.5 THEN i END) AS half_life
  FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY cohort_period) - 1 AS i FROM ret) GROUP BY cohort)"""


@register("half_life", oracle("SELECT * FROM hl", views=V, ctes=[COH, RET, HALF], ints=["half_life"]))
def q_half_life(spark, sf):
    """First period index below 50% retention."""
    return co.half_life(co.retention(_monthly(spark, sf), P))


@register("period_churn", oracle("""
SELECT cohort, cohort_period, CASE WHEN cohort_period = 0 THEN 0.0 ELSE
  1.0 - retention / nullif(lag(retention) OVER (PARTITION BY cohort ORDER BY cohort_period), 0) END AS churn_rate
FROM ret""", views=V, ctes=[COH, RET], doubles=["churn_rate"], ints=["cohort_period"]))
def q_period_churn(spark, sf):
    """Incremental churn between consecutive periods."""
    return co.period_churn(co.retention(_monthly(spark, sf), P))


MILES = "mil AS (SELECT cohort, " + ", ".join(
    f"arg_max(retention, CASE WHEN cohort_period <= {m} THEN cohort_period END) AS M{m}"
    for m in (0,) + tuple(P.milestones)) + " FROM ret GROUP BY cohort)"
MILE_D = [f"M{m}" for m in (0,) + tuple(P.milestones)]


@register("retention_milestones", oracle("SELECT * FROM mil", views=V, ctes=[COH, RET, MILES], doubles=MILE_D))
def q_milestones(spark, sf):
    """C14: retention milestones with as-of fallback."""
    return co.milestones(co.retention(_monthly(spark, sf), P), P.milestones)


@register("cumulative_revenue", oracle(f"""
SELECT cohort, cohort_period, revenue,
  sum(revenue) OVER (PARTITION BY cohort ORDER BY cohort_period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS cumulative_revenue
FROM (SELECT g.cohort, g.cohort_period, coalesce(r.revenue, 0.0) AS revenue
      FROM (SELECT c.cohort, p.cohort_period FROM (SELECT DISTINCT cohort FROM r0) c
            CROSS JOIN (SELECT DISTINCT cohort_period FROM r0) p) g
      LEFT JOIN r0 r ON g.cohort = r.cohort AND g.cohort_period = r.cohort_period)""", views=V, ctes=[COH, f"""r0 AS (
  SELECT cohort, cohort_period, sum(revenue) AS revenue FROM coh WHERE cohort_period <= {P.max_periods}
  GROUP BY cohort, cohort_period)"""], doubles=["revenue", "cumulative_revenue"]))
def q_cumulative_revenue(spark, sf):
    """Cumulative revenue per cohort over periods."""
    return co.cumulative_revenue(_monthly(spark, sf), P.max_periods)


@register("full_cohort_analysis", oracle("SELECT mil.*, hl.half_life FROM mil LEFT JOIN hl ON mil.cohort = hl.cohort",
                                         views=V, ctes=[COH, RET, MILES, HALF], doubles=MILE_D, ints=["half_life"]))
def q_full_cohort_analysis(spark, sf):
    """Filter -> retention -> milestones and half-life."""
    return co.full_cohort_analysis(_monthly(spark, sf), P)


REPORT = f"""rc0 AS (SELECT cohort, customer_id, cohort_period, count(*) AS events, sum(CAST(revenue AS DECIMAL(18, 2))) AS revenue, count(revenue) AS orders
  FROM coh WHERE cohort IS NOT NULL AND customer_id IS NOT NULL AND cohort_period IS NOT NULL GROUP BY ALL),
rc1 AS (SELECT *, cohort_period = min(cohort_period) OVER w AS is_new, max(cohort_period) OVER w AS last_p FROM rc0
  WINDOW w AS (PARTITION BY cohort, customer_id)),
rc2 AS (SELECT cohort, cohort_period, count(*) AS customers, count_if(is_new) AS new, sum(CASE WHEN is_new THEN last_p ELSE 0 END) AS life,
    sum(events) AS events, sum(revenue) AS revenue, sum(orders) AS orders FROM rc1 GROUP BY ALL),
rc3 AS (SELECT * FROM rc2 WHERE cohort IN (SELECT cohort FROM rc2 GROUP BY cohort HAVING sum(new) >= {P.min_cohort_size})),
near AS (SELECT * FROM rc3 WHERE cohort_period <= {P.max_periods}),
rd AS (SELECT a.cohort, b.cohort_period, coalesce(customers, 0) AS customers, coalesce(new, 0) AS new, coalesce(life, 0) AS life,
    coalesce(events, 0) AS events, coalesce(revenue, 0.0) AS revenue, coalesce(orders, 0) AS orders
  FROM (SELECT DISTINCT cohort FROM near) a CROSS JOIN (SELECT DISTINCT cohort_period FROM near) b LEFT JOIN near USING (cohort, cohort_period)),
rb AS (SELECT *, max(CASE WHEN cohort_period = 0 THEN customers END) OVER (PARTITION BY cohort) AS base,
    row_number() OVER (PARTITION BY cohort ORDER BY cohort_period) - 1 AS i FROM rd),
rr AS (SELECT *, CASE WHEN base >= {P.min_cohort_size} THEN min(customers / base) OVER w END AS retention, sum(revenue) OVER w AS cumulative_revenue
  FROM rb WINDOW w AS (PARTITION BY cohort ORDER BY cohort_period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rt AS (SELECT cohort, cohort_period, customers, new, life, events, revenue, orders, i, retention, cumulative_revenue,
    CASE WHEN retention IS NOT NULL AND cohort_period = 0 THEN 0.0
         ELSE 1 - retention / nullif(lag(retention) OVER (PARTITION BY cohort ORDER BY cohort_period), 0) END AS period_churn FROM rr
  UNION ALL SELECT cohort, cohort_period, customers, new, life, events, revenue, orders, NULL, NULL, NULL, NULL FROM rc3
  WHERE cohort_period > {P.max_periods})"""


@register("cohort_report", oracle("""
SELECT cohort, cohort_period, CASE WHEN gc = 1 AND gp = 1 THEN 'all' WHEN gc = 1 THEN 'period' WHEN gp = 1 THEN 'cohort' ELSE 'cell' END AS level,
  CASE WHEN gp = 1 THEN new ELSE customers END::BIGINT AS customers, events::BIGINT AS events, revenue, revenue / nullif(orders, 0) AS avg_order_value,
  retention, 1 - retention AS churn_rate, period_churn, CASE WHEN gc = 0 AND gp = 0 THEN cumulative_revenue END AS cumulative_revenue,
  CASE WHEN gc = 0 AND gp = 1 THEN max_period END AS max_period, CASE WHEN gp = 1 THEN life / new END AS avg_lifetime_periods,
  CASE WHEN gc = 0 AND gp = 1 THEN half_life END AS half_life
FROM (SELECT cohort, cohort_period, grouping(cohort) AS gc, grouping(cohort_period) AS gp, sum(new) AS new, sum(customers) AS customers,
    sum(events) AS events, sum(revenue) AS revenue, sum(orders) AS orders, avg(retention) AS retention, avg(period_churn) AS period_churn,
    max(cumulative_revenue) AS cumulative_revenue, max(CASE WHEN events > 0 THEN cohort_period END) AS max_period, sum(life) AS life,
    min(CASE WHEN retention < 0.5 THEN i END) AS half_life
  FROM rt GROUP BY GROUPING SETS ((cohort, cohort_period), (cohort_period), (cohort), ()))""",
    views=V, ctes=[COH, REPORT], doubles=["revenue", "avg_order_value", "retention", "churn_rate", "period_churn", "cumulative_revenue",
                                          "avg_lifetime_periods"], ints=["cohort_period", "max_period", "half_life"]))
def q_cohort_report(spark, sf):
    """The whole cohort analysis as one table, by GROUPING SETS over the cells (revenue as exact decimals)."""
    return co.cohort_report(_monthly(spark, sf).withColumn("revenue", F.col("revenue").cast("decimal(18,2)")), P)


LASTW = f"""lw AS (SELECT a.* FROM activity a
  JOIN (SELECT customer_id, max(event_date) AS l FROM activity GROUP BY customer_id) m ON a.customer_id = m.customer_id
  WHERE a.event_date >= m.l - {SEQ_DAYS})"""


@register("churn_sequences", oracle("""
SELECT sequence, count(*) AS count FROM (
  SELECT customer_id, string_agg(event_type, ' -> ' ORDER BY event_date, event_id) AS sequence
  FROM lw WHERE customer_id IN (SELECT customer_id FROM cust WHERE churn_label = 1) GROUP BY customer_id)
WHERE sequence <> '' GROUP BY sequence ORDER BY count DESC, sequence LIMIT 5""",
    views=["cust", "activity"], ctes=[LASTW]))
def q_churn_sequences(spark, sf):
    """C17: top-5 pre-churn event sequences (a top-k report)."""
    return co.churn_sequences(tb.activity_events(spark, sf), tb.customers(spark, sf), SEQ_DAYS, 5)


@register("pre_churn_events", oracle("""
SELECT event_type, coalesce(avg(CASE WHEN churn_label = 1 THEN cnt END), 0.0) AS churned_freq,
  coalesce(avg(CASE WHEN churn_label = 0 THEN cnt END), 0.0) AS active_freq,
  coalesce(avg(CASE WHEN churn_label = 1 THEN cnt END), 0.0)
    / nullif(coalesce(avg(CASE WHEN churn_label = 0 THEN cnt END), 0.0), 0) AS freq_ratio
FROM (SELECT customer_id, event_type, count(*) AS cnt FROM lw GROUP BY customer_id, event_type) x
JOIN cust USING (customer_id) WHERE churn_label IS NOT NULL GROUP BY event_type""",
    views=["cust", "activity"], ctes=[LASTW], doubles=["churned_freq", "active_freq", "freq_ratio"]))
def q_pre_churn_events(spark, sf):
    """Pre-churn event frequencies, churned vs active."""
    return co.pre_churn_events(tb.activity_events(spark, sf), tb.customers(spark, sf), SEQ_DAYS)


def _funnel_sql() -> str:
    stages = list(co.STAGES)
    dates = {"Signup": "s0", "First Purchase": "d1", "Repeat Purchase": "d2", "Loyal": "d5", "Churned": "dc"}
    members = {"Signup": "true", "First Purchase": "d1 IS NOT NULL", "Repeat Purchase": "d2 IS NOT NULL",
               "Loyal": "d5 IS NOT NULL", "Churned": "is_churned"}
    parts = []
    for i, st in enumerate(stages):
        m = members[st]
        since = f"CASE WHEN {m} THEN date_diff('day', s0, {dates[st]}) END"
        if st == "Signup":
            trans = f"CASE WHEN {m} THEN 0 END"
        elif st == "Churned":
            trans = f"CASE WHEN {m} THEN date_diff('day', coalesce(d5, d2, d1, s0), dc) END"
        else:
            trans = f"CASE WHEN {m} THEN date_diff('day', {dates[stages[i - 1]]}, {dates[st]}) END"
        if i == 0:
            is_drop, drop = "false", "NULL"
        else:
            is_drop = f"(({members[stages[i - 1]]}) AND NOT ({m}))"
            drop = f"CASE WHEN {is_drop} THEN date_diff('day', {dates[stages[i - 1]]}, last_ev) END"
        parts.append(f"SELECT {i} AS si, '{st}' AS stage, {m} AS member, CAST({since} AS DOUBLE) AS since, "
                     f"CAST({trans} AS DOUBLE) AS trans, {is_drop} AS is_drop, CAST({drop} AS DOUBLE) AS dropd FROM fc")
    return "lg AS (" + " UNION ALL ".join(parts) + ")"


FUNNEL_SQL = oracle("""
SELECT stage, count, round_even(count / greatest(tot, 1), 4) AS conversion_rate,
  round_even(CASE WHEN si = 0 THEN 0.0 WHEN prev > 0 THEN (prev - count) / prev ELSE 0.0 END, 4) AS drop_off_rate,
  round_even(avg_s, 2) AS avg_days_since_signup, round_even(med_s, 2) AS median_days_since_signup,
  round_even(avg_t, 2) AS avg_days_from_previous_stage, round_even(med_t, 2) AS median_days_from_previous_stage,
  dropoff_customer_count, round_even(avg_d, 2) AS avg_dropoff_days_after_previous_stage,
  round_even(med_d, 2) AS median_dropoff_days_after_previous_stage
FROM (SELECT *, lag(count) OVER (ORDER BY si) AS prev, first(count) OVER (ORDER BY si) AS tot FROM (
  SELECT si, stage, count_if(member) AS count, count_if(is_drop) AS dropoff_customer_count,
    avg(since) AS avg_s, median(since) AS med_s, avg(trans) AS avg_t, median(trans) AS med_t,
    avg(dropd) AS avg_d, median(dropd) AS med_d FROM lg GROUP BY si, stage))""",
    views=V, ctes=["""k AS (SELECT customer_id, event_date,
    row_number() OVER (PARTITION BY customer_id ORDER BY event_date, order_id) AS k FROM purchases)""",
                   """pd AS (SELECT customer_id, max(CASE WHEN k = 1 THEN event_date END) AS d1,
    max(CASE WHEN k = 2 THEN event_date END) AS d2, max(CASE WHEN k = 5 THEN event_date END) AS d5
  FROM k GROUP BY customer_id)""",
                   """fc AS (SELECT c.customer_id, coalesce(c.signup_date, e.first_ev) AS s0, d1, d2, d5,
    CASE WHEN coalesce(c.churn_label, 0) = 1 THEN e.last_ev END AS dc, coalesce(c.churn_label, 0) = 1 AS is_churned,
    e.last_ev
  FROM cust c LEFT JOIN pd ON c.customer_id = pd.customer_id
  LEFT JOIN (SELECT customer_id, min(event_date) AS first_ev, max(event_date) AS last_ev FROM purchases
             GROUP BY customer_id) e ON c.customer_id = e.customer_id)""", _funnel_sql()],
    doubles=["conversion_rate", "drop_off_rate", "avg_days_since_signup", "median_days_since_signup",
             "avg_days_from_previous_stage", "median_days_from_previous_stage",
             "avg_dropoff_days_after_previous_stage", "median_dropoff_days_after_previous_stage"])


@register("journey_funnel", FUNNEL_SQL)
def q_journey_funnel(spark, sf):
    """Signup -> purchases -> churn funnel."""
    return co.journey_funnel(tb.customers(spark, sf), tb.purchases(spark, sf))


@register("cohort_sizes", oracle("""SELECT strftime(signup_date, '%Y-%m') AS cohort, count(DISTINCT customer_id) AS customers
  FROM cust WHERE signup_date IS NOT NULL GROUP BY 1""", views=V))
def q_cohort_sizes(spark, sf):
    """C20: distinct customers per signup month."""
    return co.cohort_sizes(tb.customers(spark, sf))


MASK = """msk AS (SELECT r.*, (lp IS NULL OR cohort_period > lp) OR
    coalesce(CAST(strptime(cohort || '-01', '%Y-%m-%d') AS DATE) + CAST((cohort_period + 1) * 30 - 1 AS INTEGER)
             > (SELECT max(event_date) FROM purchases), false) AS unobserved
  FROM (SELECT *, max(CASE WHEN retention > 0 THEN cohort_period END) OVER (PARTITION BY cohort) AS lp FROM ret) r),
masked AS (SELECT cohort, cohort_period, customers, retention, unobserved,
    CASE WHEN NOT unobserved THEN retention END AS observed_retention FROM msk)"""


def _masked(spark, sf):
    ret = co.retention(_monthly(spark, sf), P)
    pur = tb.purchases(spark, sf)
    return co.mask_unobserved(ret, pur.agg(F.max("event_date")).scalar())


@register("mask_unobserved", oracle("SELECT * FROM masked", views=V, ctes=[COH, RET, MASK],
                                    doubles=["retention", "observed_retention"]))
def q_mask_unobserved(spark, sf):
    """Censored retention cells masked to null."""
    return _masked(spark, sf)


@register("final_retention", oracle("""
SELECT CASE WHEN n > 0 THEN a ELSE coalesce(b, 0.0) END AS final_retention,
       CASE WHEN n > 0 THEN 'last_period' ELSE 'deepest_observed' END AS basis
FROM (SELECT avg(observed_retention) AS a, count(*) AS n FROM masked
      WHERE cohort_period = (SELECT max(cohort_period) FROM masked) AND NOT unobserved)
CROSS JOIN (SELECT avg(v) AS b FROM (SELECT arg_max(observed_retention, cohort_period) AS v FROM masked
            WHERE observed_retention IS NOT NULL GROUP BY cohort))""",
    views=V, ctes=[COH, RET, MASK], doubles=["final_retention"]))
def q_final_retention(spark, sf):
    """Final retention over observed cells."""
    return co.final_retention(_masked(spark, sf))
