"""Queries: budget allocation, scenarios and what-if (B1-B20) on the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import budget as bu
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.plans.q_segment import PIPE_SQL, _pipeline_segments
from churnlens.sources import tables as tb

COLS = ["customer_id", "segment", "churn_probability", "uplift_score", "clv", "cost_per_action"]
BUDGET_SHARE = 0.3        # budget = share x total action cost of all customers
CHANNEL_SHARE = 0.05      # multi-channel total budget share
# Fixed channel parameters: (channel, unit cost, share of the channel total budget, ROI multiplier)
CHANNELS = (("push", 500.0, 0.2, 1.0), ("email", 1000.0, 0.3, 1.2), ("sms", 2000.0, 0.8, 1.5))
SCENARIOS = (("base", 1.0, 1.0, 1.0, 1.0, 1.0), ("high_cost", 1.5, 1.0, 1.0, 1.0, 1.0),
             ("low_uplift", 1.0, 0.5, 1.0, 1.0, 1.0), ("high_churn", 1.0, 1.0, 1.2, 1.0, 1.0),
             ("double_budget", 1.0, 1.0, 1.0, 1.0, 2.0))
D = ["churn_probability", "uplift_score", "clv", "cost_per_action", "priority", "efficiency", "allocated_budget"]


def _scores(spark, sf):
    return tb.scores(spark, sf).select(*COLS)


def _budget(df, share):
    return df.agg(F.sum("cost_per_action") * share).scalar()


def alloc_sql(share: float, src: str = "scores", part: str = "", budget_expr: str | None = None) -> str:
    """CTE chain ending in ``a3`` with the LP-greedy allocation and the residual pass."""
    pb = f"PARTITION BY {part} " if part else ""
    gb = f"GROUP BY {part}" if part else ""
    join_th = f"JOIN th USING ({part})" if part else "CROSS JOIN th"
    bexpr = budget_expr or f"(SELECT {share} * sum(cost_per_action) FROM scores)"
    return f"""e1 AS (SELECT *, greatest(uplift_score, 0.0) * clv * churn_probability AS priority, {bexpr} AS bgt FROM {src}),
e2 AS (SELECT *, priority / CASE WHEN cost_per_action > 0 THEN cost_per_action ELSE 1.0 END AS efficiency,
    CASE WHEN priority > 0 THEN greatest(cost_per_action, 0.0) ELSE 0.0 END AS cap FROM e1),
a1 AS (SELECT *, CASE WHEN bgt > 0 THEN greatest(0.0, least(cap, bgt - (sum(cap) OVER ({pb}ORDER BY efficiency DESC,
    customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap))) ELSE 0.0 END AS alloc FROM e2),
th AS (SELECT {part + ',' if part else ''} first(bgt) - sum(alloc) AS lft, bool_or(uplift_score > 0) AS anypos,
    median(clv) AS clvcut, quantile_cont(uplift_score, 0.1) AS upfloor FROM a1 {gb}),
a2 AS (SELECT a1.*, th.lft, CASE WHEN greatest(cost_per_action - alloc, 0.0) > 0 AND clv >= clvcut
    AND churn_probability > 0 AND uplift_score >= upfloor AND lft > 1e-6 AND anypos
    THEN greatest(cost_per_action - alloc, 0.0) ELSE 0.0 END AS rem FROM a1 {join_th}),
a3 AS (SELECT *, alloc + CASE WHEN rem > 0 THEN greatest(0.0, least(rem, lft - (sum(rem) OVER ({pb}ORDER BY clv DESC,
    customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rem))) ELSE 0.0 END AS allocated_budget FROM a2)"""


ALLOC_OUT = "SELECT " + ", ".join(COLS) + ", priority, efficiency, allocated_budget FROM a3"


@register("budget_allocation", oracle(ALLOC_OUT, views=["scores"], ctes=[alloc_sql(BUDGET_SHARE)], doubles=D))
def q_budget_allocation(spark, sf):
    """B1 (+B2): LP-optimal allocation of 30% of the total action cost."""
    s = _scores(spark, sf)
    return bu.allocate(s, _budget(s, BUDGET_SHARE))


@register("budget_residual", oracle(ALLOC_OUT, views=["scores"], ctes=[alloc_sql(1.0)], doubles=D))
def q_budget_residual(spark, sf):
    """B2: a budget above the positive-priority capacity: the leftover goes by CLV."""
    s = _scores(spark, sf)
    return bu.allocate(s, _budget(s, 1.0))


def _channel_budget(spark, sf) -> float:
    return float(_scores(spark, sf).agg(F.sum("cost_per_action")).first()[0] * CHANNEL_SHARE)


def _channels(spark, total):
    return spark.createDataFrame([(c, u, s * total) for c, u, s, _ in CHANNELS],
                                 "channel string, unit_cost double, channel_budget double")


CH_SQL = f"""tb AS (SELECT {CHANNEL_SHARE} * sum(cost_per_action) AS b FROM scores),
ch0 AS (SELECT c.channel, c.unit_cost, c.share * tb.b AS channel_budget, tb.b FROM (VALUES {", ".join(
    f"('{c}', {u}, {s})" for c, u, s, _ in CHANNELS)}) AS c(channel, unit_cost, share) CROSS JOIN tb),
ch1 AS (SELECT *, sum(channel_budget) OVER (ORDER BY unit_cost, channel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS cumb FROM ch0),
ch2 AS (SELECT *, (least(cumb, b) - least(cumb - channel_budget, b)) / unit_cost AS units FROM ch1),
ch AS (SELECT channel, unit_cost, sum(units) OVER (ORDER BY unit_cost, channel ROWS BETWEEN UNBOUNDED PRECEDING AND
    CURRENT ROW) - units AS u_lo, sum(units) OVER (ORDER BY unit_cost, channel ROWS BETWEEN UNBOUNDED PRECEDING AND
    CURRENT ROW) AS u_hi FROM ch2),
cr AS (SELECT customer_id, priority, CAST(row_number() OVER (ORDER BY priority DESC, customer_id) AS DOUBLE) AS r
  FROM (SELECT customer_id, greatest(uplift_score, 0.0) * clv * churn_probability AS priority FROM scores)
  WHERE priority > 0),
mc AS (SELECT cr.customer_id, ch.channel, least(r, u_hi) - greatest(r - 1, u_lo) AS units,
    (least(r, u_hi) - greatest(r - 1, u_lo)) * unit_cost AS allocated_budget, priority
  FROM cr JOIN ch ON ch.u_lo < cr.r AND ch.u_hi > cr.r - 1 WHERE least(r, u_hi) - greatest(r - 1, u_lo) > 0)"""


@register("channel_allocation", oracle("SELECT * FROM mc", views=["scores"], ctes=[CH_SQL],
                                       doubles=["units", "allocated_budget", "priority"]))
def q_channel_allocation(spark, sf):
    """One unit per customer over three channels with channel and total budgets."""
    total = _channel_budget(spark, sf)
    return bu.allocate_channels(_scores(spark, sf), _channels(spark, total), total)


@register("channel_summary", oracle("""SELECT channel, sum(allocated_budget) AS allocated_budget, sum(units) AS units,
  count(*) AS customers FROM mc GROUP BY channel""", views=["scores"], ctes=[CH_SQL], doubles=["allocated_budget", "units"]))
def q_channel_summary(spark, sf):
    """Allocation by channel."""
    return bu.channel_summary(q_channel_allocation(spark, sf))


@register("customer_channel_totals", oracle("""SELECT customer_id, sum(allocated_budget) AS allocated_budget,
  sum(units) AS units FROM mc GROUP BY customer_id""", views=["scores"], ctes=[CH_SQL],
    doubles=["allocated_budget", "units"]))
def q_customer_totals(spark, sf):
    """Allocation by customer over channels."""
    return bu.customer_totals(q_channel_allocation(spark, sf))


PRI = "greatest(uplift_score, 0.0) * clv * churn_probability"


@register("allocate_proportional", oracle(f"""
SELECT {", ".join(COLS)}, {PRI} AS priority,
  CASE WHEN tp > 0 THEN {PRI} / tp * b ELSE 0.0 END AS allocated_budget
FROM scores CROSS JOIN (SELECT sum({PRI}) AS tp, {BUDGET_SHARE} * sum(cost_per_action) AS b FROM scores)""",
    views=["scores"], doubles=["churn_probability", "uplift_score", "clv", "cost_per_action", "priority",
                               "allocated_budget"]))
def q_allocate_proportional(spark, sf):
    """Proportional-to-priority baseline."""
    s = _scores(spark, sf)
    return bu.allocate_proportional(s, float(s.agg(F.sum("cost_per_action")).first()[0] * BUDGET_SHARE))


@register("allocate_uniform", oracle(f"""
SELECT {", ".join(COLS)}, {PRI} AS priority,
  CASE WHEN {PRI} > 0 AND n > 0 THEN b / n ELSE 0.0 END AS allocated_budget
FROM scores CROSS JOIN (SELECT count_if({PRI} > 0) AS n, {BUDGET_SHARE} * sum(cost_per_action) AS b FROM scores)""",
    views=["scores"], doubles=["churn_probability", "uplift_score", "clv", "cost_per_action", "priority",
                               "allocated_budget"]))
def q_allocate_uniform(spark, sf):
    """Uniform baseline over eligible customers."""
    s = _scores(spark, sf)
    return bu.allocate_uniform(s, float(s.agg(F.sum("cost_per_action")).first()[0] * BUDGET_SHARE))


FRAC = "coalesce(least(greatest(allocated_budget / nullif(cost_per_action, 0), 0.0), 1.0), 0.0)"
METRICS_SEL = f"""sum(allocated_budget) AS total_allocated, sum({FRAC} * {PRI}) AS expected_value,
  count_if(allocated_budget > 0) AS customers_treated,
  CASE WHEN sum(allocated_budget) > 0 THEN sum({FRAC} * {PRI}) / sum(allocated_budget) ELSE 0.0 END AS roi"""
MET_D = ["total_allocated", "expected_value", "roi"]


@register("allocation_metrics", oracle(f"SELECT {METRICS_SEL} FROM a3", views=["scores"],
                                       ctes=[alloc_sql(BUDGET_SHARE)], doubles=MET_D))
def q_allocation_metrics(spark, sf):
    """Value, ROI and customers treated of the LP allocation."""
    return bu.allocation_metrics(q_budget_allocation(spark, sf))


RET = f"{FRAC} * greatest(uplift_score, 0.0) * least(greatest(churn_probability, 0.0), 1.0)"
BM_SQL = f"""bm AS (SELECT a3.*, {RET} AS expected_retained, {RET} * clv AS revenue_saved,
  CASE WHEN allocated_budget > 0 THEN {RET} * clv / allocated_budget ELSE 0.0 END AS roi,
  greatest(uplift_score, 0.0) * clv AS priority_score FROM a3)"""


@register("strategy_comparison", oracle(f"""
SELECT 'lp' AS strategy, total_allocated, expected_value AS retained_value, roi, customers_treated FROM (
  SELECT {METRICS_SEL} FROM a3)
UNION ALL SELECT 'proportional', total_allocated, expected_value, roi, customers_treated FROM (SELECT {METRICS_SEL} FROM (
  SELECT scores.* , CASE WHEN tp > 0 THEN {PRI} / tp * b ELSE 0.0 END AS allocated_budget FROM scores CROSS JOIN tot))
UNION ALL SELECT 'uniform', total_allocated, expected_value, roi, customers_treated FROM (SELECT {METRICS_SEL} FROM (
  SELECT scores.* , CASE WHEN {PRI} > 0 THEN b / np ELSE 0.0 END AS allocated_budget FROM scores CROSS JOIN tot))""",
    views=["scores"], ctes=[alloc_sql(BUDGET_SHARE), f"""tot AS (SELECT sum({PRI}) AS tp, count_if({PRI} > 0) AS np,
  {BUDGET_SHARE} * sum(cost_per_action) AS b FROM scores)"""], doubles=["total_allocated", "retained_value", "roi"]))
def q_strategy_comparison(spark, sf):
    """The LP, proportional and uniform strategies side by side."""
    s = _scores(spark, sf)
    return bu.compare_strategies(s, float(s.agg(F.sum("cost_per_action")).first()[0] * BUDGET_SHARE))


@register("budget_metrics", oracle("SELECT " + ", ".join(COLS) + """, priority, efficiency, allocated_budget,
  expected_retained, revenue_saved, roi, priority_score FROM bm""", views=["scores"],
    ctes=[alloc_sql(BUDGET_SHARE), BM_SQL], doubles=D + ["expected_retained", "revenue_saved", "roi", "priority_score"]))
def q_budget_metrics(spark, sf):
    """Per-customer expected retained, revenue saved and ROI."""
    return bu.budget_metrics(q_budget_allocation(spark, sf))


@register("no_action_policy", oracle(f"""
SELECT customer_id, value_segment, uplift_score, no_action, CASE WHEN no_action THEN 0.0 ELSE allocated_budget END AS allocated_budget,
  CASE WHEN no_action THEN 0.0 ELSE expected_retained END AS expected_retained,
  CASE WHEN no_action THEN 0.0 ELSE revenue_saved END AS revenue_saved, CASE WHEN no_action THEN 0.0 ELSE roi END AS roi
FROM (SELECT a.*, p.segment AS value_segment,
        (a.uplift_score <= 0 OR coalesce(contains(lower(p.segment), 'sleeping_dog'), false)) AS no_action
      FROM bm a JOIN ({PIPE_SQL}) p ON a.customer_id = p.customer_id)""", views=["scores"],
    ctes=[alloc_sql(BUDGET_SHARE), BM_SQL],
    doubles=["uplift_score", "allocated_budget", "expected_retained", "revenue_saved", "roi"]))
def q_no_action(spark, sf):
    """Zero spend for non-positive uplift or sleeping-dog value segments."""
    a = bu.budget_metrics(q_budget_allocation(spark, sf))
    seg = _pipeline_segments(spark, sf).select("customer_id", F.col("segment").alias("value_segment"))
    return bu.no_action(a.join(seg, "customer_id"), "value_segment").select(
        "customer_id", "value_segment", "uplift_score", "no_action", "allocated_budget", "expected_retained",
        "revenue_saved", "roi")


@register("budget_by_segment", oracle("""
SELECT segment, count(*) AS customers, sum(allocated_budget) AS allocated_budget,
  sum(expected_retained) AS expected_retained, sum(revenue_saved) AS revenue_saved,
  CASE WHEN sum(allocated_budget) > 0 THEN sum(revenue_saved) / sum(allocated_budget) ELSE 0.0 END AS roi
FROM bm GROUP BY segment""", views=["scores"], ctes=[alloc_sql(BUDGET_SHARE), BM_SQL],
    doubles=["allocated_budget", "expected_retained", "revenue_saved", "roi"]))
def q_budget_by_segment(spark, sf):
    """Budget sums and ROI by segment."""
    return bu.budget_by_segment(bu.budget_metrics(q_budget_allocation(spark, sf)))


@register("cost_tiers", oracle("""SELECT customer_id, uplift_score, CASE WHEN uplift_score > 0.1 THEN 70000.0
  WHEN uplift_score > 0.02 THEN 30000.0 ELSE 1000.0 END AS cost_per_action FROM scores""",
    views=["scores"], doubles=["uplift_score", "cost_per_action"]))
def q_cost_tiers(spark, sf):
    """Action cost tiers by uplift."""
    return bu.cost_tiers(_scores(spark, sf).select("customer_id", "uplift_score"))


def scen_sql(rows) -> str:
    vals = ", ".join(f"('{r[0]}', {r[1]}, {r[2]}, {r[3]}, {r[4]}, {r[5]})" for r in rows)
    return f"""sc AS (SELECT s.customer_id, s.segment, s.cost_per_action * m.cost_mult AS cost_per_action,
    s.uplift_score * m.uplift_mult AS uplift_score,
    least(greatest(s.churn_probability * m.churn_mult, 0.0), 1.0) AS churn_probability, s.clv * m.clv_mult AS clv,
    m.scenario, m.bmult * (SELECT {BUDGET_SHARE} * sum(cost_per_action) FROM scores) AS sbudget
  FROM scores s CROSS JOIN (VALUES {vals}) AS m(scenario, cost_mult, uplift_mult, churn_mult, clv_mult, bmult))"""


def _scen_query(rows):
    return oracle(f"SELECT scenario, {METRICS_SEL} FROM a3 GROUP BY scenario", views=["scores"],
                  ctes=[scen_sql(rows), alloc_sql(0, "sc", "scenario", "sbudget").replace(
                      "th AS (SELECT scenario,", "th AS (SELECT scenario,")], doubles=MET_D)


def _scen_df(spark, sf, rows):
    s = _scores(spark, sf)
    base = float(s.agg(F.sum("cost_per_action")).first()[0] * BUDGET_SHARE)
    tab = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5] * base) for r in rows], bu.SCENARIO_SCHEMA)
    return bu.run_scenarios(s, tab, residual=True)


@register("scenario_comparison", _scen_query(SCENARIOS))
def q_scenarios(spark, sf):
    """B11 + B13: reallocation under five scenarios, one summary row each."""
    return _scen_df(spark, sf, SCENARIOS)


UPLIFT_SWEEP = tuple((f"uplift={v}", 1.0, v, 1.0, 1.0, 1.0) for v in (0.5, 1.0, 1.5))
BUDGET_SWEEP = tuple((f"budget={v}", 1.0, 1.0, 1.0, 1.0, v) for v in (0.5, 1.0, 2.0))


@register("parameter_sweep", _scen_query(UPLIFT_SWEEP))
def q_parameter_sweep(spark, sf):
    """One-at-a-time sweep of the uplift multiplier."""
    return _scen_df(spark, sf, UPLIFT_SWEEP)


@register("budget_sweep", _scen_query(BUDGET_SWEEP))
def q_budget_sweep(spark, sf):
    """0.5x, 1x and 2x of the budget."""
    return _scen_df(spark, sf, BUDGET_SWEEP)


@register("projected_outcomes", oracle(f"""
SELECT avg(s.churn_probability) AS baseline_churn,
  avg(greatest(s.churn_probability - coalesce(least(greatest(a.allocated_budget / nullif(s.cost_per_action, 0), 0.0), 1.0), 0.0)
      * greatest(s.uplift_score, 0.0), 0.0)) AS projected_churn,
  sum(coalesce(least(greatest(a.allocated_budget / nullif(s.cost_per_action, 0), 0.0), 1.0), 0.0)
      * greatest(s.uplift_score, 0.0) * s.clv * s.churn_probability) AS revenue_impact
FROM (SELECT customer_id, allocated_budget FROM a3 WHERE allocated_budget > 0) a RIGHT JOIN scores s
  ON a.customer_id = s.customer_id""", views=["scores"], ctes=[alloc_sql(BUDGET_SHARE)],
    doubles=["baseline_churn", "projected_churn", "revenue_impact"]))
def q_projected(spark, sf):
    """Projected churn and revenue with the allocation (funded customers right-joined)."""
    a = q_budget_allocation(spark, sf).filter(F.col("allocated_budget") > 0)
    return bu.project(_scores(spark, sf), a)


@register("validate_budget_input", oracle("""
SELECT count_if(churn_probability IS NULL) AS null_churn_probability, count_if(uplift_score IS NULL) AS null_uplift_score,
  count_if(clv IS NULL) AS null_clv, count_if(cost_per_action IS NULL) AS null_cost_per_action,
  count_if(churn_probability < 0 OR churn_probability > 1) AS bad_churn,
  count_if(uplift_score < -1 OR uplift_score > 1) AS bad_uplift, count_if(clv < 0) AS negative_clv,
  count_if(cost_per_action <= 0) AS non_positive_cost, count(*) - count(DISTINCT customer_id) AS duplicate_ids,
  count_if(churn_probability IS NULL) + count_if(uplift_score IS NULL) + count_if(clv IS NULL)
  + count_if(cost_per_action IS NULL) + count_if(churn_probability < 0 OR churn_probability > 1)
  + count_if(uplift_score < -1 OR uplift_score > 1) + count_if(clv < 0) + count_if(cost_per_action <= 0)
  + count(*) - count(DISTINCT customer_id) = 0 AS valid
FROM scores""", views=["scores"]))
def q_validate_budget_input(spark, sf):
    """Budget input validation."""
    return bu.validate_budget_input(_scores(spark, sf))


NPV = bu.npv_factor(0.1, 12)


@register("npv", oracle(f"""SELECT customer_id, clv, {NPV!r} AS npv_factor, clv * {NPV!r} AS clv_npv FROM scores""",
                        views=["scores"], doubles=["clv", "npv_factor", "clv_npv"]))
def q_npv(spark, sf):
    """12-month NPV factor at 10% a year applied to CLV."""
    return bu.npv(_scores(spark, sf).select("customer_id", "clv"), "clv", 0.1, 12)


@register("scaled_scenarios", oracle(f"""
SELECT m.*, t.budget_multiplier, total_allocated * budget_multiplier AS scaled_budget, expected_value * budget_multiplier AS scaled_value,
  floor(customers_treated * budget_multiplier) AS scaled_treated,
  CASE WHEN total_allocated * budget_multiplier > 0 THEN expected_value / total_allocated ELSE 0.0 END AS envelope_roi,
  CASE WHEN floor(customers_treated * budget_multiplier) > 0
       THEN expected_value * budget_multiplier / floor(customers_treated * budget_multiplier) ELSE 0.0 END
    AS value_per_treated
FROM (SELECT {METRICS_SEL} FROM a3) m CROSS JOIN (VALUES (0.5), (1.0), (1.5), (2.0)) AS t(budget_multiplier)""",
    views=["scores"], ctes=[alloc_sql(BUDGET_SHARE)],
    doubles=MET_D + ["budget_multiplier", "scaled_budget", "scaled_value", "scaled_treated", "envelope_roi",
                     "value_per_treated"]))
def q_scaled_scenarios(spark, sf):
    """Linear scaling of the allocation summary by budget multipliers."""
    return bu.scaled_scenarios(bu.allocation_metrics(q_budget_allocation(spark, sf)), [0.5, 1.0, 1.5, 2.0])


@register("channel_split", oracle(f"""
SELECT channel, unit_cost, multiplier, CAST(trunc(b * (multiplier / greatest(tm, 0.01))) AS BIGINT) AS channel_budget,
  CAST(trunc(trunc(b * (multiplier / greatest(tm, 0.01))) / greatest(unit_cost, 1.0)) AS BIGINT) AS expected_actions
FROM (VALUES {", ".join(f"('{c}', {u}, {m})" for c, u, _, m in CHANNELS)}) AS c(channel, unit_cost, multiplier)
CROSS JOIN (SELECT sum(m) AS tm FROM (VALUES {", ".join(f"({m})" for *_, m in CHANNELS)}) AS t(m))
CROSS JOIN (SELECT {BUDGET_SHARE} * sum(cost_per_action) AS b FROM scores)""", views=["scores"],
    doubles=["unit_cost", "multiplier"]))
def q_channel_split(spark, sf):
    """Budget split by channel weight and expected actions."""
    s = _scores(spark, sf)
    b = float(s.agg(F.sum("cost_per_action")).first()[0] * BUDGET_SHARE)
    ch = spark.createDataFrame([(c, u, m) for c, u, _, m in CHANNELS], "channel string, unit_cost double, multiplier double")
    return bu.channel_split(ch, b)


# Fixed channel table of the min / max LP: (channel, unit cost, ROI multiplier, min share, max share of the budget)
LP_CHANNELS = (("push", 5000.0, 1.0, 0.05, 0.30), ("email", 10000.0, 1.2, 0.10, 0.50), ("sms", 20000.0, 1.5, 0.0, 0.60))
LP_SHARE = 0.1

LP_SQL = f"""lb AS (SELECT {LP_SHARE} * sum(cost_per_action) AS b FROM scores),
lch AS (SELECT c.channel, c.unit_cost, c.roi_multiplier, c.mn * lb.b AS min_budget, c.mx * lb.b AS max_budget, lb.b
  FROM (VALUES {", ".join(f"('{c}', {u}, {m}, {a}, {x})" for c, u, m, a, x in LP_CHANNELS)})
    AS c(channel, unit_cost, roi_multiplier, mn, mx) CROSS JOIN lb),
it AS (SELECT s.customer_id, l.*, greatest(s.uplift_score, 0.0) * s.clv * s.churn_probability * l.roi_multiplier AS density,
    CASE WHEN greatest(s.uplift_score, 0.0) * s.clv * s.churn_probability * l.roi_multiplier > 0
         THEN least(s.cost_per_action, l.unit_cost) ELSE 0.0 END AS u
  FROM scores s CROSS JOIN lch l),
i1 AS (SELECT *, greatest(0.0, least(u, min_budget - (sum(u) OVER (PARTITION BY channel ORDER BY density DESC, customer_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - u))) AS a1 FROM it),
i2 AS (SELECT *, u - a1 AS r FROM i1),
i3 AS (SELECT *, greatest(0.0, least(r, (max_budget - min_budget) - (sum(r) OVER (PARTITION BY channel ORDER BY density DESC,
    customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r))) AS e FROM i2),
fz AS (SELECT (SELECT sum(min_budget) FROM lch) > (SELECT b FROM lb)
    OR (SELECT count(*) FROM (SELECT channel, sum(u) AS cp, any_value(min_budget) AS mb FROM it GROUP BY channel) WHERE cp < mb) > 0
    AS infeasible, (SELECT b FROM lb) - (SELECT sum(min_budget) FROM lch) AS lft),
i4 AS (SELECT i3.*, fz.infeasible, fz.lft, sum(e) OVER (ORDER BY density DESC, channel, customer_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge FROM i3 CROSS JOIN fz),
lp AS (SELECT customer_id, channel, density,
    CASE WHEN infeasible THEN 0.0 ELSE a1 + greatest(0.0, least(e, lft - (ge - e))) END AS allocated_budget,
    CASE WHEN infeasible THEN 'infeasible' ELSE 'optimal' END AS status FROM i4)"""


@register("allocate_lp", oracle("SELECT * FROM lp", views=["scores"], ctes=[LP_SQL],
                                doubles=["density", "allocated_budget"]))
def q_allocate_lp(spark, sf):
    """Multi-channel allocation with channel minima / maxima and ROI multipliers."""
    s = _scores(spark, sf)
    b = float(s.agg(F.sum("cost_per_action")).first()[0] * LP_SHARE)
    ch = spark.createDataFrame([(c, u, m, a * b, x * b) for c, u, m, a, x in LP_CHANNELS],
                               "channel string, unit_cost double, roi_multiplier double, min_budget double, "
                               "max_budget double")
    return bu.allocate_lp(s, ch, b)
