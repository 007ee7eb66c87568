"""Retention-budget allocation and what-if scenarios.

The reference solves ``max sum(eff_i * x_i), 0 <= x_i <= cost_i, sum(x_i) <= B`` with an
LP solver over a dense matrix. That LP is a fractional knapsack: its optimum funds
customers in decreasing efficiency until the budget is spent, so here it is one
distributed prefix sum (``global_order``) of the capacities in efficiency order:
``x = clip(B - capacity_before, 0, cost)``. Scenarios add a leading partition key; the
multi-channel case is an interval overlap of the customer prefix with a tiny channel
table. Ties in efficiency are broken by ``customer_id`` (the LP optimum is not unique).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.prefix import global_order
from churnlens.functions.quantiles import grouped_quantiles

ID = "customer_id"


def priority_expr(uplift="uplift_score", clv="clv", churn="churn_probability") -> Column:
    return F.greatest(F.col(uplift), F.lit(0.0)) * F.col(clv) * F.col(churn)


def with_efficiency(df: DataFrame) -> DataFrame:
    cost = F.col("cost_per_action")
    safe = F.when(cost > 0, cost).otherwise(1.0)
    return (df.withColumn("priority", priority_expr())
            .withColumn("efficiency", F.col("priority") / safe)
            .withColumn("__cap", F.when(F.col("priority") > 0, F.greatest(cost, F.lit(0.0))).otherwise(0.0)))


def _budget_col(budget) -> Column:
    return budget if isinstance(budget, Column) else F.lit(float(budget))


def allocate(df: DataFrame, budget, scenario_col: str | None = None, residual: bool = True) -> DataFrame:
    """B1 (+ B2): LP-optimal allocation by efficiency; then the residual pass.

    ``budget`` is a number or a column (per scenario). Output adds ``priority``,
    ``efficiency`` and ``allocated_budget``.
    """
    part = [scenario_col] if scenario_col else []
    e = with_efficiency(df)
    o = global_order(e, [("efficiency", False), (ID, True)], partition_by=part, sums={"__cum": "__cap"},
                     rank_col=None)
    b = _budget_col(budget)
    alloc = F.greatest(F.lit(0.0), F.least(F.col("__cap"), b - (F.col("__cum") - F.col("__cap"))))
    o = o.withColumn("allocated_budget", F.when(b > 0, alloc).otherwise(0.0)).drop("__cum")
    if residual:
        o = allocate_residual(o, budget, scenario_col)
    return o.drop("__cap")


def allocate_residual(alloc: DataFrame, budget, scenario_col: str | None = None) -> DataFrame:
    """B2: leftover budget to customers with CLV >= median, churn > 0 and uplift >= the 10%
    quantile, by CLV descending up to their remaining capacity; only when some uplift > 0."""
    part = [scenario_col] if scenario_col else []
    b = _budget_col(budget)
    stats = alloc.groupBy(*part).agg((F.first(b) - F.sum("allocated_budget")).alias("__left"),
                                     F.bool_or(F.col("uplift_score") > 0).alias("__anypos"))
    # Both quantiles from one table of distinct values, in one order.
    metric = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
    long = alloc.select(*part, F.explode(F.array(metric("clv"), metric("uplift_score"))).alias("x")).select(*part, "x.*")
    pick = lambda c, i: F.max(F.when((F.col("metric") == c) & (F.col("q_index") == i), F.col("q")))
    cuts = grouped_quantiles(long, "value", [0.1, 0.5], [*part, "metric"]).groupBy(*part).agg(
        pick("clv", 1).alias("__clvcut"), pick("uplift_score", 0).alias("__upfloor"))
    th = stats.join(cuts, part, "left") if part else stats.crossJoin(F.broadcast(cuts))
    j = alloc.join(F.broadcast(th), part) if part else alloc.crossJoin(F.broadcast(th))
    rem = F.greatest(F.col("cost_per_action") - F.col("allocated_budget"), F.lit(0.0))
    cand = ((rem > 0) & (F.col("clv") >= F.col("__clvcut")) & (F.col("churn_probability") > 0)
            & (F.col("uplift_score") >= F.col("__upfloor")) & (F.col("__left") > 1e-6) & F.col("__anypos"))
    j = j.withColumn("__rem", F.when(cand, rem).otherwise(0.0))
    o = global_order(j, [("clv", False), (ID, True)], partition_by=part, sums={"__rcum": "__rem"}, rank_col=None)
    add = F.greatest(F.lit(0.0), F.least(F.col("__rem"), F.col("__left") - (F.col("__rcum") - F.col("__rem"))))
    return (o.withColumn("allocated_budget", F.col("allocated_budget") + F.when(F.col("__rem") > 0, add).otherwise(0.0))
            .drop("__left", "__anypos", "__clvcut", "__upfloor", "__rem", "__rcum"))


def allocate_channels(df: DataFrame, channels: DataFrame, budget: float) -> DataFrame:
    """One unit per customer over channels ``(channel, unit_cost, channel_budget)``.

    The value of a unit does not depend on the channel, so the optimum buys units in the
    cheapest channels first (within their budgets and the total) and gives them to the
    customers in decreasing priority. Channel unit capacities come from the tiny channel
    table; each customer's unit interval [r-1, r) overlaps at most a few channel
    intervals (a range join against a broadcast table).
    """
    ch = sorted(channels.collect(), key=lambda r: (float(r["unit_cost"]), r["channel"]))
    rows, left, u0 = [], float(budget), 0.0
    for r in ch:
        spend = max(0.0, min(float(r["channel_budget"]), left))
        units = spend / float(r["unit_cost"]) if float(r["unit_cost"]) > 0 else 0.0
        left -= spend
        rows.append((r["channel"], float(r["unit_cost"]), u0, u0 + units))
        u0 += units
    spark = df.sparkSession
    ct = spark.createDataFrame(rows, "channel string, unit_cost double, u_lo double, u_hi double")
    e = df.withColumn("priority", priority_expr()).filter(F.col("priority") > 0)
    o = global_order(e, [("priority", False), (ID, True)], rank_col="__r")
    r = F.col("__r").cast("double")
    j = o.join(F.broadcast(ct), (F.col("u_lo") < r) & (F.col("u_hi") > r - 1))
    x = F.least(r, F.col("u_hi")) - F.greatest(r - 1, F.col("u_lo"))
    return j.select(ID, "channel", x.alias("units"), (x * F.col("unit_cost")).alias("allocated_budget"),
                    "priority").filter(F.col("units") > 0)


def allocate_proportional(df: DataFrame, budget: float) -> DataFrame:
    """Share of total priority x budget; nothing when the total or the budget is 0."""
    p = df.withColumn("priority", priority_expr())
    t = p.agg(F.sum("priority").alias("__tp"))
    j = p.crossJoin(F.broadcast(t))
    a = F.when((F.col("__tp") > 0) & F.lit(budget > 0), F.col("priority") / F.col("__tp") * budget).otherwise(0.0)
    return j.withColumn("allocated_budget", a).drop("__tp")


def allocate_uniform(df: DataFrame, budget: float) -> DataFrame:
    """Budget / n over eligible (priority > 0) customers."""
    p = df.withColumn("priority", priority_expr())
    t = p.agg(F.count_if(F.col("priority") > 0).alias("__n"))
    j = p.crossJoin(F.broadcast(t))
    return j.withColumn("allocated_budget", F.when((F.col("priority") > 0) & (F.col("__n") > 0),
                                                   budget / F.col("__n")).otherwise(0.0)).drop("__n")


def allocation_metrics(alloc: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """value = sum(clip(alloc / cost, 0, 1) * max(uplift, 0) * clv * churn); ROI; treated."""
    frac = F.least(F.greatest(F.try_divide(F.col("allocated_budget"), F.col("cost_per_action")), F.lit(0.0)),
                   F.lit(1.0))
    v = F.coalesce(frac, F.lit(0.0)) * priority_expr()
    g = alloc.groupBy(*(group_cols or [])).agg(
        F.sum("allocated_budget").alias("total_allocated"), F.sum(v).alias("expected_value"),
        F.count_if(F.col("allocated_budget") > 0).alias("customers_treated"))
    return g.withColumn("roi", F.when(F.col("total_allocated") > 0,
                                      F.col("expected_value") / F.col("total_allocated")).otherwise(0.0))


def compare_strategies(df: DataFrame, budget: float) -> DataFrame:
    """Value, ROI and customers treated of the LP, proportional and uniform allocations."""
    cols = [ID, "uplift_score", "clv", "churn_probability", "cost_per_action", "allocated_budget"]
    parts = {"lp": allocate(df, budget), "proportional": allocate_proportional(df, budget),
             "uniform": allocate_uniform(df, budget)}
    union = None
    for name, a in parts.items():
        a = a.select(F.lit(name).alias("strategy"), *cols)
        union = a if union is None else union.unionByName(a)
    m = allocation_metrics(union, ["strategy"])
    return m.select("strategy", "total_allocated", F.col("expected_value").alias("retained_value"), "roi",
                    "customers_treated")


def budget_metrics(alloc: DataFrame) -> DataFrame:
    """Per-customer expected retained (fraction x uplift x churn), revenue saved, ROI and
    priority_score (uplift x CLV)."""
    frac = F.coalesce(F.least(F.greatest(F.try_divide(F.col("allocated_budget"), F.col("cost_per_action")),
                                         F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    churn = F.least(F.greatest(F.col("churn_probability"), F.lit(0.0)), F.lit(1.0))
    up = F.greatest(F.col("uplift_score"), F.lit(0.0))
    ret = frac * up * churn
    return (alloc.withColumn("expected_retained", ret)
            .withColumn("revenue_saved", ret * F.col("clv"))
            .withColumn("roi", F.when(F.col("allocated_budget") > 0,
                                      F.col("revenue_saved") / F.col("allocated_budget")).otherwise(0.0))
            .withColumn("priority_score", up * F.col("clv")))


def no_action(alloc: DataFrame, segment_col: str = "segment") -> DataFrame:
    """No spend and nothing expected where uplift <= 0 or the segment names a sleeping dog
    (in any letter case)."""
    bad = (F.col("uplift_score") <= 0) | F.coalesce(F.lower(segment_col).contains("sleeping_dog"), F.lit(False))
    money = [c for c in ("allocated_budget", "expected_retained", "revenue_saved", "roi") if c in alloc.columns]
    return alloc.withColumns({"no_action": bad, **{c: F.when(bad, 0.0).otherwise(F.col(c)) for c in money}})


def budget_by_segment(metrics: DataFrame, segment_col: str = "segment") -> DataFrame:
    """Sums and ROI by segment."""
    g = metrics.groupBy(segment_col).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("allocated_budget").alias("allocated_budget"),
        F.sum("expected_retained").alias("expected_retained"), F.sum("revenue_saved").alias("revenue_saved"))
    return g.withColumn("roi", F.when(F.col("allocated_budget") > 0,
                                      F.col("revenue_saved") / F.col("allocated_budget")).otherwise(0.0))


def cost_tiers(df: DataFrame, uplift_col: str = "uplift_score") -> DataFrame:
    """Action cost tiers by uplift (fixed values 70000 / 30000 / 1000)."""
    u = F.col(uplift_col)
    return df.withColumn("cost_per_action", F.when(u > 0.1, 70000.0).when(u > 0.02, 30000.0).otherwise(1000.0))


def scenario_frame(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every customer under every scenario ``(scenario, cost_mult, uplift_mult,
    churn_mult, clv_mult, budget)``; churn clipped to [0, 1]. The scenario table is tiny
    and broadcast."""
    j = df.crossJoin(F.broadcast(scenarios))
    return (j.withColumn("cost_per_action", F.col("cost_per_action") * F.col("cost_mult"))
            .withColumn("uplift_score", F.col("uplift_score") * F.col("uplift_mult"))
            .withColumn("churn_probability", F.least(F.greatest(F.col("churn_probability") * F.col("churn_mult"),
                                                                F.lit(0.0)), F.lit(1.0)))
            .withColumn("clv", F.col("clv") * F.col("clv_mult")))


def run_scenarios(df: DataFrame, scenarios: DataFrame, residual: bool = False) -> DataFrame:
    """Allocation per scenario (scenario is the leading prefix key) + summary."""
    s = scenario_frame(df, scenarios)
    a = allocate(s, F.col("budget"), scenario_col="scenario", residual=residual)
    return allocation_metrics(a, ["scenario"])


def vary_scenarios(spark, base_budget: float, param: str, values: list[float]) -> DataFrame:
    """One-at-a-time parameter sweep as a scenario table."""
    rows = []
    for v in values:
        m = {"cost_mult": 1.0, "uplift_mult": 1.0, "churn_mult": 1.0, "clv_mult": 1.0}
        budget = base_budget
        if param == "budget":
            budget = base_budget * v
        else:
            m[f"{param}_mult"] = float(v)
        rows.append((f"{param}={v}", m["cost_mult"], m["uplift_mult"], m["churn_mult"], m["clv_mult"], float(budget)))
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


SCENARIO_SCHEMA = ("scenario string, cost_mult double, uplift_mult double, churn_mult double, clv_mult double, "
                   "budget double")


def budget_sweep(spark, base_budget: float, levels=(0.5, 1.0, 2.0)) -> DataFrame:
    """0.5x, 1x, 2x of the budget."""
    return vary_scenarios(spark, base_budget, "budget", list(levels))


def project(df: DataFrame, alloc: DataFrame) -> DataFrame:
    """Projected churn mean(max(churn - frac * max(uplift, 0), 0)) and revenue impact
    sum(frac * max(uplift, 0) * clv * churn); customers without allocation have fraction 0."""
    a = alloc.select(ID, "allocated_budget")
    j = a.join(df, ID, "right")
    frac = F.coalesce(F.least(F.greatest(F.try_divide(F.col("allocated_budget"), F.col("cost_per_action")),
                                         F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    pc = F.greatest(F.col("churn_probability") - frac * F.greatest(F.col("uplift_score"), F.lit(0.0)), F.lit(0.0))
    return j.agg(F.avg("churn_probability").alias("baseline_churn"), F.avg(pc).alias("projected_churn"),
                 F.sum(frac * F.greatest(F.col("uplift_score"), F.lit(0.0)) * F.col("clv") * F.col("churn_probability"))
                 .alias("revenue_impact"))


def channel_summary(alloc: DataFrame) -> DataFrame:
    """Allocation by channel."""
    return alloc.groupBy("channel").agg(F.sum("allocated_budget").alias("allocated_budget"),
                                        F.sum("units").alias("units"), F.count(F.lit(1)).alias("customers"))


def customer_totals(alloc: DataFrame) -> DataFrame:
    """Allocation by customer over channels."""
    return alloc.groupBy(ID).agg(F.sum("allocated_budget").alias("allocated_budget"), F.sum("units").alias("units"))


def validate_budget_input(df: DataFrame) -> DataFrame:
    """Nulls, out-of-range values and duplicate ids in one aggregate row."""
    cols = ["churn_probability", "uplift_score", "clv", "cost_per_action"]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    aggs += [F.count_if((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1)).alias("bad_churn"),
             F.count_if((F.col("uplift_score") < -1) | (F.col("uplift_score") > 1)).alias("bad_uplift"),
             F.count_if(F.col("clv") < 0).alias("negative_clv"),
             F.count_if(F.col("cost_per_action") <= 0).alias("non_positive_cost"),
             (F.count(F.lit(1)) - F.count_distinct(ID)).alias("duplicate_ids")]
    s = df.agg(*aggs)
    total = sum(F.col(c) for c in s.columns)
    return s.withColumn("valid", total == 0)


def npv_factor(rate: float, horizon_months: int) -> float:
    """Sum over m < h of (1 + r) ** (-m / 12)."""
    return sum((1 + rate) ** (-m / 12) for m in range(horizon_months))


def npv(df: DataFrame, value_col: str, rate: float = 0.1, horizon_months: int = 12) -> DataFrame:
    """B18 applied to a value column (the factor is an ``aggregate`` over a sequence)."""
    fac = F.aggregate(F.sequence(F.lit(0), F.lit(horizon_months - 1)), F.lit(0.0),
                      lambda acc, m: acc + F.pow(F.lit(1 + rate), -m / 12.0))
    return df.withColumn("npv_factor", fac).withColumn(f"{value_col}_npv", F.col(value_col) * F.col("npv_factor"))


def scaled_scenarios(summary: DataFrame, multipliers: list[float]) -> DataFrame:
    """A budget summary scaled linearly by budget multipliers, with ROI variants."""
    spark = summary.sparkSession
    m = spark.createDataFrame([(float(x),) for x in multipliers], "budget_multiplier double")
    j = summary.crossJoin(F.broadcast(m))
    return (j.withColumn("scaled_budget", F.col("total_allocated") * F.col("budget_multiplier"))
            .withColumn("scaled_value", F.col("expected_value") * F.col("budget_multiplier"))
            .withColumn("scaled_treated", F.floor(F.col("customers_treated") * F.col("budget_multiplier")))
            .withColumn("envelope_roi", F.when(F.col("scaled_budget") > 0,
                                               F.col("scaled_value") / F.col("scaled_budget")).otherwise(0.0))
            .withColumn("value_per_treated", F.when(F.col("scaled_treated") > 0,
                                                    F.col("scaled_value") / F.col("scaled_treated")).otherwise(0.0)))


def channel_split(channels: DataFrame, budget: float) -> DataFrame:
    """Whole currency units of budget x multiplier / max(sum of multipliers, 0.01) per
    channel, and whole actions at a cost of at least 1."""
    t = channels.agg(F.sum("multiplier").alias("__tm"))     # one row
    j = channels.crossJoin(F.broadcast(t))
    b = (F.lit(budget) * (F.col("multiplier") / F.greatest(F.col("__tm"), F.lit(0.01)))).cast("long")
    actions = (F.col("channel_budget") / F.greatest(F.col("unit_cost"), F.lit(1.0))).cast("long")
    return j.withColumn("channel_budget", b).withColumn("expected_actions", actions).drop("__tm")


def allocate_lp(df: DataFrame, channels: DataFrame, budget: float) -> DataFrame:
    """Items (customer, channel) with value density priority x ROI multiplier and
    capacity min(cost, channel unit cost); channel totals in [min, max]; total <= budget.

    Fractional LP solved greedily (nested caps): each channel first funds its minimum
    from its own best items; the leftover budget then goes in global density order to
    each channel's remaining items, truncated to the channel's residual maximum.
    ``status`` is ``infeasible`` when the minima exceed the budget or a channel cannot
    reach its minimum; the channel table is tiny (broadcast cross join).
    """
    ch = channels.select("channel", "unit_cost", "roi_multiplier", "min_budget", "max_budget")
    items = (df.withColumn("priority", priority_expr()).crossJoin(F.broadcast(ch))
             .withColumn("density", F.col("priority") * F.col("roi_multiplier"))
             .withColumn("__u", F.when(F.col("density") > 0, F.least(F.col("cost_per_action"), F.col("unit_cost")))
                         .otherwise(0.0)))
    o = global_order(items, [("density", False), (ID, True)], partition_by=["channel"], sums={"__cu": "__u"},
                     rank_col=None)
    a1 = F.greatest(F.lit(0.0), F.least(F.col("__u"), F.col("min_budget") - (F.col("__cu") - F.col("__u"))))
    o = o.withColumn("__a1", a1).withColumn("__r", F.col("__u") - F.col("__a1"))
    o = global_order(o, [("density", False), (ID, True)], partition_by=["channel"], sums={"__cr": "__r"},
                     rank_col=None)
    cap = F.col("max_budget") - F.col("min_budget")
    o = o.withColumn("__e", F.greatest(F.lit(0.0), F.least(F.col("__r"), cap - (F.col("__cr") - F.col("__r")))))
    feas = ch.agg(F.sum("min_budget").alias("__mins"))
    chan_cap = items.groupBy("channel").agg(F.sum("__u").alias("__capc"), F.first("min_budget").alias("__minc"))
    bad = chan_cap.agg(F.count_if(F.col("__capc") < F.col("__minc")).alias("__short"))
    st = feas.crossJoin(bad).select(
        ((F.col("__mins") > budget) | (F.col("__short") > 0)).alias("__infeasible"),
        (F.lit(budget) - F.col("__mins")).alias("__left"))
    o = o.crossJoin(F.broadcast(st))
    o = global_order(o, [("density", False), ("channel", True), (ID, True)], sums={"__ge": "__e"}, rank_col=None)
    a2 = F.greatest(F.lit(0.0), F.least(F.col("__e"), F.col("__left") - (F.col("__ge") - F.col("__e"))))
    alloc = F.when(F.col("__infeasible"), 0.0).otherwise(F.col("__a1") + a2)
    return o.select(ID, "channel", "density", alloc.alias("allocated_budget"),
                    F.when(F.col("__infeasible"), "infeasible").otherwise("optimal").alias("status"))
