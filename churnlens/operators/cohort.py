"""Cohorts, retention and journeys.

Every result is in long form ``(cohort, cohort_period, value)``; a pivot is only a
view. All heavy work is a ``groupBy`` on (cohort, period) or on customer; the
(cohort x period) grid is tiny and is densified with a broadcast cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.config import CohortParams
from churnlens.functions.prefix import global_order, top_k_per_group
from churnlens.functions.quantiles import grouped_quantiles
from churnlens.functions.columns import small_table
from churnlens.session import cut_lineage


# ------------------------------------------------------------------ C1-C5

def month_label(d: str | Column) -> Column:
    return F.date_format(F.col(d) if isinstance(d, str) else d, "yyyy-MM")


def iso_week_label(d: str | Column) -> Column:
    c = F.col(d) if isinstance(d, str) else d
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def _month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def assign_cohorts(df: DataFrame, kind: str = "monthly", date_col: str = "event_date",
                   signup_col: str | None = "signup_date", behavior_col: str | None = None,
                   id_col: str = "customer_id", order_col: str | None = None) -> DataFrame:
    """Add ``cohort`` and ``cohort_period``.

    monthly: cohort = signup month; period = floor(days / 30) clipped at 0 with a signup
    column, calendar-month difference from the first event without one.
    weekly: ISO ``YYYY-Www`` of signup (else first event); period = floor(days / 7).
    behavioral: first non-null ``behavior_col`` by date; period = month difference.
    """
    d = F.col(date_col)
    w = Window.partitionBy(id_col)
    use_signup = signup_col is not None and signup_col in df.columns
    if kind == "behavioral":
        order = F.struct(d, F.col(order_col)) if order_col else d
        first_val = (df.filter(F.col(behavior_col).isNotNull()).groupBy(id_col)
                     .agg(F.min_by(behavior_col, order).alias("cohort")))
        first_date = df.groupBy(id_col).agg(F.min(date_col).alias("__first"))
        out = df.join(first_val, id_col, "left").join(first_date, id_col, "left")
        return (out.withColumn("cohort_period", _month_index(d) - _month_index(F.col("__first")))
                .drop("__first"))
    if use_signup:
        first = F.col(signup_col)
        out = df.withColumn("__first", first)
    else:
        out = df.withColumn("__first", F.min(d).over(w))
    days = F.datediff(d, F.col("__first"))
    if kind == "monthly":
        period = F.greatest(F.floor(days / 30), F.lit(0)) if use_signup \
            else _month_index(d) - _month_index(F.col("__first"))
        out = out.withColumn("cohort", month_label("__first")).withColumn("cohort_period", period.cast("int"))
    elif kind == "weekly":
        out = (out.withColumn("cohort", iso_week_label("__first"))
               .withColumn("cohort_period", F.floor(days / 7).cast("int")))
    else:
        raise ValueError(f"unknown cohort type {kind!r}")
    return out.drop("__first")


def cohort_label(df: DataFrame, date_col: str, kind: str = "monthly", out_col: str = "cohort") -> DataFrame:
    """``YYYY-MM`` or ISO ``YYYY-Www``; rows with an invalid date are dropped."""
    lab = month_label(date_col) if kind == "monthly" else iso_week_label(date_col)
    return df.filter(F.col(date_col).isNotNull()).withColumn(out_col, lab)


def compact_cohorts(events: DataFrame, customers: DataFrame, kind: str = "monthly") -> DataFrame:
    """C4: distinct (customer, cohort, period): a period-0 row for every customer with a
    signup date, plus one row per active (customer, period); 30- or 7-day buckets >= 0."""
    size = 30 if kind == "monthly" else 7
    cust = customers.filter(F.col("signup_date").isNotNull()).select(
        "customer_id", "signup_date",
        (month_label("signup_date") if kind == "monthly" else iso_week_label("signup_date")).alias("cohort"))
    base = cust.select("customer_id", "cohort", F.lit(0).alias("cohort_period"))
    act = (events.select("customer_id", "event_date").join(cust, "customer_id")
           .select("customer_id", "cohort",
                   F.greatest(F.floor(F.datediff("event_date", "signup_date") / size), F.lit(0))
                   .cast("int").alias("cohort_period")))
    return base.unionByName(act).dropDuplicates(["customer_id", "cohort", "cohort_period"])


# ------------------------------------------------------------------ C6-C9

def _counts(cohorts: DataFrame, max_periods: int) -> DataFrame:
    return (cohorts.filter(F.col("cohort_period") <= max_periods)
            .select("cohort", "cohort_period", "customer_id").distinct()
            .groupBy("cohort", "cohort_period").agg(F.count(F.lit(1)).alias("customers")))


def _grid(counts: DataFrame, value_cols: list[str], cohorts: DataFrame | None = None) -> DataFrame:
    """Densify: every cohort x every observed period, missing cells 0."""
    cs = (cohorts if cohorts is not None else counts).select("cohort").distinct()
    ps = counts.select("cohort_period").distinct()
    grid = cs.crossJoin(F.broadcast(ps))
    return grid.join(counts, ["cohort", "cohort_period"], "left").na.fill(0, value_cols)


def retention(cohorts: DataFrame, p: CohortParams = CohortParams()) -> DataFrame:
    """``(cohort, cohort_period, customers, retention)``, densified with 0, cohorts with
    period-0 size >= min, divided by period 0, then a running minimum over periods."""
    cnt = _counts(cohorts, p.max_periods)
    dense = _grid(cnt, ["customers"])
    w = Window.partitionBy("cohort")
    base = F.max(F.when(F.col("cohort_period") == 0, F.col("customers"))).over(w)
    any_base = cnt.agg(F.coalesce(F.bool_or(F.col("cohort_period") == 0), F.lit(False)).alias("__any"))     # one row
    out = dense.withColumn("__base", base).crossJoin(F.broadcast(any_base))
    # Without a period 0 anywhere the counts stand for the shares.
    out = out.filter(~F.col("__any") | (F.col("__base") >= p.min_cohort_size)).withColumn(
        "__r", F.when(F.col("__any"), F.try_divide("customers", "__base")).otherwise(F.col("customers").cast("double")))
    wr = Window.partitionBy("cohort").orderBy("cohort_period").rowsBetween(Window.unboundedPreceding, 0)
    return (out.withColumn("retention", F.min("__r").over(wr))
            .select("cohort", "cohort_period", "customers", "retention"))


def cohort_metrics(cohorts: DataFrame, max_periods: int = 12, revenue_col: str = "revenue") -> DataFrame:
    """Customer count, revenue sum and mean order value per (cohort, period), 0-filled."""
    f = cohorts.filter(F.col("cohort_period") <= max_periods)
    g = f.groupBy("cohort", "cohort_period").agg(
        F.count_distinct("customer_id").alias("customer_count"),
        F.sum(revenue_col).alias("revenue"), F.avg(revenue_col).alias("avg_order_value"))
    return _grid(g, ["customer_count", "revenue", "avg_order_value"])


def churn_matrix(ret: DataFrame) -> DataFrame:
    """C7 churn metric: 1 - retention."""
    return ret.select("cohort", "cohort_period", (1.0 - F.col("retention")).alias("churn_rate"))


def cohort_summary(cohorts: DataFrame, revenue_col: str | None = "revenue") -> DataFrame:
    """Customers, events, max period, mean per-customer max period, revenue."""
    per_c = cohorts.groupBy("cohort", "customer_id").agg(F.max("cohort_period").alias("__mp"))
    life = per_c.groupBy("cohort").agg(F.avg("__mp").alias("avg_lifetime_periods"))
    aggs = [F.count_distinct("customer_id").alias("total_customers"),
            F.count("cohort_period").alias("total_events"), F.max("cohort_period").alias("max_period")]
    if revenue_col and revenue_col in cohorts.columns:
        aggs.append(F.sum(revenue_col).alias("total_revenue"))
    return cohorts.groupBy("cohort").agg(*aggs).join(life, "cohort")


def filter_cohorts(cohorts: DataFrame, names: list[str] | None = None, min_size: int = 5) -> DataFrame:
    """Keep named cohorts with at least ``min_size`` distinct customers."""
    f = cohorts if names is None else cohorts.filter(F.col("cohort").isin(names))
    ok = (f.groupBy("cohort").agg(F.count_distinct("customer_id").alias("__n"))
          .filter(F.col("__n") >= min_size).select("cohort"))
    return f.join(ok, "cohort", "left_semi")     # as many names as the column has: left to AQE


# ------------------------------------------------------------------ C10-C15

def retention_curves(ret: DataFrame) -> DataFrame:
    """One array of retention values per cohort, by period."""
    g = ret.filter(F.col("retention").isNotNull()).groupBy("cohort").agg(
        F.array_sort(F.collect_list(F.struct("cohort_period", "retention"))).alias("__s"))
    return g.select("cohort", F.transform("__s", lambda x: x["retention"]).alias("curve"))


def average_curve(ret: DataFrame) -> DataFrame:
    """C11: mean retention per period over cohorts (nulls skipped)."""
    return ret.groupBy("cohort_period").agg(F.avg("retention").alias("avg_retention"))


def half_life(ret: DataFrame) -> DataFrame:
    """First period index with retention < 0.5, else null."""
    w = Window.partitionBy("cohort").orderBy("cohort_period")
    r = ret.filter(F.col("retention").isNotNull()).withColumn("__i", F.row_number().over(w) - 1)
    return r.groupBy("cohort").agg(F.min(F.when(F.col("retention") < 0.5, F.col("__i"))).alias("half_life"))


def period_churn(ret: DataFrame) -> DataFrame:
    """1 - r(p) / r(previous period); previous 0 -> null; period 0 -> 0."""
    w = Window.partitionBy("cohort").orderBy("cohort_period")
    prev = F.lag("retention").over(w)
    churn = F.when(F.col("cohort_period") == 0, F.lit(0.0)).otherwise(
        1.0 - F.try_divide(F.col("retention"), F.when(prev != 0, prev)))
    return ret.select("cohort", "cohort_period", churn.alias("churn_rate"))


def milestones(ret: DataFrame, marks=(1, 3, 6, 12), include_m0: bool = True) -> DataFrame:
    """C14: M0 / M1 / M3 / M6 / M12 -- exact period, else the latest period <= the mark
    (an as-of lookup: ``max_by(value, period)`` filtered to periods <= mark)."""
    sel = ([0] if include_m0 else []) + list(marks)
    aggs = [F.max_by(F.col("retention"), F.when(F.col("cohort_period") <= m, F.col("cohort_period")))
            .alias(f"M{m}") for m in sel]
    return ret.groupBy("cohort").agg(*aggs)


def cumulative_revenue(cohorts: DataFrame, max_periods: int = 12, revenue_col: str = "revenue") -> DataFrame:
    """Running revenue sum over periods (densified) per cohort."""
    g = (cohorts.filter(F.col("cohort_period") <= max_periods)
         .groupBy("cohort", "cohort_period").agg(F.sum(revenue_col).alias("revenue")))
    d = _grid(g, ["revenue"])
    wr = Window.partitionBy("cohort").orderBy("cohort_period").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cumulative_revenue", F.sum("revenue").over(wr))


def full_cohort_analysis(cohorts: DataFrame, p: CohortParams = CohortParams()) -> DataFrame:
    """Filter -> retention -> milestones + half-life, one row per cohort."""
    f = filter_cohorts(cohorts, None, p.min_cohort_size)
    ret = retention(f, p)
    return milestones(ret, p.milestones).join(half_life(ret), "cohort", "left")


def cohort_report(cohorts: DataFrame, p: CohortParams = CohortParams(), revenue_col: str = "revenue") -> DataFrame:
    """The whole analysis as one long table with a row for each cell (cohort, period), each period
    over all cohorts, each cohort over its periods, and all.

    The events are read once, into one row a customer, cohort and period; these become the table of the cells, which
    the number of cohorts and periods bounds, and GROUPING SETS over it give the four ``level``s:

    * ``customers``: distinct customers of a cell, their sum over the cohorts of a period, and each customer
      once for a cohort and in all; ``events``, ``revenue`` and ``avg_order_value`` likewise;
    * ``retention`` and ``churn_rate`` (1 - retention) of a cell (the running minimum, as ``retention`` gives it), and
      their mean at the other levels, so the rows of the periods are the average curve; ``period_churn`` likewise;
    * ``cumulative_revenue`` of a cell, over the periods so far;
    * ``max_period``, ``avg_lifetime_periods`` (mean of the customers' last periods) and ``half_life`` (first period
      index below one half) of a cohort.

    Cohorts below the minimum size are left out; those whose period 0 is below it, and periods beyond the
    maximum, have no retention. Rows without a customer, cohort or period are left out.
    """
    rows = cohorts.filter(F.col("customer_id").isNotNull() & F.col("cohort").isNotNull() & F.col("cohort_period").isNotNull())
    cell = rows.groupBy("cohort", "customer_id", "cohort_period").agg(
        F.count(F.lit(1)).alias("events"), F.sum(revenue_col).alias("revenue"), F.count(revenue_col).alias("orders"))
    mine = Window.partitionBy("cohort", "customer_id")
    cell = cell.withColumns({"__new": (F.col("cohort_period") == F.min("cohort_period").over(mine)).cast("long"),
                             "__last": F.max("cohort_period").over(mine)})
    cells = cut_lineage(cell.groupBy("cohort", "cohort_period").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("__new").alias("new"), F.sum(F.col("__new") * F.col("__last")).alias("life"),
        F.sum("events").alias("events"), F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")))
    whole = Window.partitionBy("cohort")
    cells = cells.withColumn("__size", F.sum("new").over(whole)).filter(F.col("__size") >= p.min_cohort_size).drop("__size")
    near = cells.filter(F.col("cohort_period") <= p.max_periods)
    values = ["customers", "new", "life", "events", "revenue", "orders"]
    dense = _grid(near, values).withColumn("seen", F.col("events") > 0)
    ordered = whole.orderBy("cohort_period")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    base = F.max(F.when(F.col("cohort_period") == 0, F.col("customers"))).over(whole)
    dense = dense.withColumn("__base", base)
    dense = dense.withColumn("retention", F.min(F.when(F.col("__base") >= p.min_cohort_size,
                                                       F.try_divide("customers", "__base"))).over(so_far))
    before = F.lag("retention").over(ordered)
    dense = dense.withColumns({
        "period_churn": F.when(F.col("retention").isNotNull() & (F.col("cohort_period") == 0), 0.0).otherwise(
            1.0 - F.try_divide(F.col("retention"), F.when(before != 0, before))),
        "cumulative_revenue": F.sum("revenue").over(so_far), "__i": F.row_number().over(ordered) - 1}).drop("__base")
    late = cells.filter(F.col("cohort_period") > p.max_periods).withColumn("seen", F.lit(True))
    table = dense.unionByName(late, allowMissingColumns=True)
    of_period, of_cohort = F.grouping("cohort") == 1, F.grouping("cohort_period") == 1
    level = (F.when(of_period & of_cohort, "all").when(of_period, "period").when(of_cohort, "cohort").otherwise("cell"))
    one_cohort = of_cohort & ~of_period
    return table.groupingSets([["cohort", "cohort_period"], ["cohort_period"], ["cohort"], []], "cohort", "cohort_period").agg(
        level.alias("level"),
        F.when(of_cohort, F.sum("new")).otherwise(F.sum("customers")).alias("customers"),
        F.sum("events").alias("events"), F.sum("revenue").alias("revenue"),
        F.try_divide(F.sum("revenue").cast("double"), F.sum("orders")).alias("avg_order_value"),
        F.avg("retention").alias("retention"), (1.0 - F.avg("retention")).alias("churn_rate"),
        F.avg("period_churn").alias("period_churn"),
        F.when(~of_cohort & ~of_period, F.max("cumulative_revenue")).alias("cumulative_revenue"),
        F.when(one_cohort, F.max(F.when(F.col("seen"), F.col("cohort_period")))).alias("max_period"),
        F.when(of_cohort, F.try_divide(F.sum("life"), F.sum("new"))).alias("avg_lifetime_periods"),
        F.when(one_cohort, F.min(F.when(F.col("retention") < 0.5, F.col("__i")))).alias("half_life"))


# ------------------------------------------------------------------ C17-C20

def _last_window(events: DataFrame, n_days: int) -> DataFrame:
    last = events.groupBy("customer_id").agg(F.max("event_date").alias("__last"))
    return (events.join(last, "customer_id")
            .filter(F.col("event_date") >= F.date_sub("__last", n_days)).drop("__last"))


#: Events (or letters) of a sequence by which C17 chooses among equal counts before it builds whole sequences.
PREFIX_EVENTS = 1_000
_ARROW = " -> "


def churn_sequences(events: DataFrame, customers: DataFrame, n_days: int = 30, top_n: int = 5,
                    order_col: str = "event_id", max_events: int | None = None) -> DataFrame:
    """C17: churned customers' events of the last ``n_days`` (with ``max_events``, of each customer at
    most that many) joined by `` -> ``; top-N.

    Sequences are counted by fingerprints of 128 bits (sums of hashes of event and position, so a
    customer's events need not meet in one task); only the top candidates' sequences are built.
    """
    churned = customers.filter(F.col("churn_label") == 1).select("customer_id")
    win = _last_window(events.join(churned, "customer_id", "left_semi"), n_days)
    if max_events is not None:
        latest = Window.partitionBy("customer_id").orderBy(F.desc("event_date"), F.desc(order_col))
        win = win.withColumn("__rn", F.row_number().over(latest)).filter(F.col("__rn") <= max_events)
    win = (win.filter(F.col("event_type").isNotNull())
           .select("customer_id", "event_date", F.col(order_col).alias("__o"), "event_type"))
    piece = F.concat("event_type", F.lit(_ARROW))
    # Where a type's own text may pass for the separator, sequences are compared by letters.
    if events.filter(F.locate(_ARROW, piece) <= F.length("event_type")).isEmpty():
        units = win.withColumn("__at", F.lit(0)).withColumn("__unit", F.col("event_type"))
    else:
        units = win.select("*", F.posexplode(F.split(piece, "")).alias("__at", "__unit"))
    ranked = global_order(units, [("event_date", True), ("__o", True), ("event_type", True), ("__at", True)],
                          rank_col="__pos", partition_by=["customer_id"])
    prints = ranked.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__at") == 0).alias("__events"), F.max(F.length("event_type")).alias("__long"),
        *[F.sum(F.xxhash64(F.lit(i), "__pos", "__unit").cast("decimal(20,0)")).alias(f"__h{i}") for i in (0, 1)])
    prints = prints.filter((F.col("__events") > 1) | (F.col("__long") > 0))      # the sequence is not empty
    counts = cut_lineage(prints.groupBy("__n", "__h0", "__h1").agg(
        F.count(F.lit(1)).alias("count"), F.min_by(F.struct("customer_id", "__n"), "customer_id").alias("__c"))
        .select("__c.*", "count"))
    least = counts.orderBy(F.desc("count")).limit(top_n).agg(F.min("count")).first()[0] or 0
    top = counts.filter(F.col("count") >= least)

    def built(rows: DataFrame) -> DataFrame:
        s = F.array_sort(F.collect_list(F.struct("__pos", "event_type")))
        return rows.groupBy("customer_id").agg(F.array_join(F.transform(s, lambda x: x["event_type"]), _ARROW).alias("sequence"))

    # Of the equal counts at the end, those that their first events do not rule out.
    first = (ranked.filter((F.col("__pos") <= PREFIX_EVENTS) & (F.col("__at") == 0))
             .join(top.filter(F.col("count") == least).select("customer_id"), "customer_id", "left_semi"))
    ties = cut_lineage(built(first).join(top, "customer_id"))
    smallest = ties.orderBy("sequence").limit(top_n).collect()      # at most top_n short texts
    stays = F.lit(False)
    if smallest:
        stays = F.col("sequence") <= smallest[-1]["sequence"]
        for r in smallest:
            if r["__n"] > PREFIX_EVENTS:
                stays = stays | F.startswith("sequence", F.lit(r["sequence"]))
    chosen = (top.filter(F.col("count") > least).select("customer_id", "count")
              .unionByName(ties.filter(stays).select("customer_id", "count")))
    whole = built(ranked.filter(F.col("__at") == 0).join(chosen.select("customer_id"), "customer_id", "left_semi"))
    return (whole.join(chosen, "customer_id").select("sequence", "count")
            .orderBy(F.desc("count"), F.asc("sequence")).limit(top_n))


def pre_churn_events(events: DataFrame, customers: DataFrame, n_days: int = 30) -> DataFrame:
    """Mean per-customer count of each event type in the last ``n_days``, churned vs active."""
    win = _last_window(events, n_days)
    cnt = win.groupBy("customer_id", "event_type").agg(F.count(F.lit(1)).alias("cnt"))
    lab = customers.select("customer_id", "churn_label").filter(F.col("churn_label").isNotNull())
    j = cnt.join(lab, "customer_id")
    g = j.groupBy("event_type").agg(
        F.coalesce(F.avg(F.when(F.col("churn_label") == 1, F.col("cnt"))), F.lit(0.0)).alias("churned_freq"),
        F.coalesce(F.avg(F.when(F.col("churn_label") == 0, F.col("cnt"))), F.lit(0.0)).alias("active_freq"))
    return g.withColumn("freq_ratio", F.try_divide(F.col("churned_freq"),
                                                   F.when(F.col("active_freq") != 0, F.col("active_freq"))))


STAGES = ("Signup", "First Purchase", "Repeat Purchase", "Loyal", "Churned")


def journey_funnel(customers: DataFrame, events: DataFrame, order_col: str = "order_id") -> DataFrame:
    """Signup -> 1st -> 2nd -> 5th purchase -> Churned funnel with timing evidence.

    The 1st / 2nd / 5th purchase dates come from a skew-safe top-5 per customer;
    means and medians per stage are distributed aggregates (exact medians by
    ``grouped_quantiles``); 4-digit rates and 2-digit day figures use half-even rounding.
    """
    pur = events.filter(F.col("event_type") == "purchase").select("customer_id", "event_date", order_col)
    first5 = top_k_per_group(pur, ["customer_id"], [F.asc("event_date"), F.asc(order_col)], 5, "__k",
                             salt_col=order_col)
    pd_ = first5.groupBy("customer_id").agg(
        F.max(F.when(F.col("__k") == 1, F.col("event_date"))).alias("d1"),
        F.max(F.when(F.col("__k") == 2, F.col("event_date"))).alias("d2"),
        F.max(F.when(F.col("__k") == 5, F.col("event_date"))).alias("d5"))
    ev_span = events.groupBy("customer_id").agg(F.min("event_date").alias("first_ev"),
                                                F.max("event_date").alias("last_ev"))
    c = (customers.select("customer_id", "signup_date", "churn_label")
         .join(pd_, "customer_id", "left").join(ev_span, "customer_id", "left"))
    churned = F.coalesce(F.col("churn_label"), F.lit(0)) == 1
    # per-customer stage dates: read by the stage aggregates and by the exact medians
    c = cut_lineage(c.select(
        "customer_id", F.coalesce("signup_date", "first_ev").alias("s0"), "d1", "d2", "d5",
        F.when(churned, F.col("last_ev")).alias("dc"), churned.alias("is_churned"), "last_ev"))
    members = {"Signup": F.lit(True), "First Purchase": F.col("d1").isNotNull(),
               "Repeat Purchase": F.col("d2").isNotNull(), "Loyal": F.col("d5").isNotNull(),
               "Churned": F.col("is_churned")}
    dates = {"Signup": F.col("s0"), "First Purchase": F.col("d1"), "Repeat Purchase": F.col("d2"),
             "Loyal": F.col("d5"), "Churned": F.col("dc")}
    rows = []
    for i, st in enumerate(STAGES):
        m = members[st]
        since = F.when(m, F.datediff(dates[st], "s0"))
        if st == "Signup":
            trans = F.when(m, F.lit(0))
        elif st == "Churned":
            trans = F.when(m, F.datediff("dc", F.coalesce("d5", "d2", "d1", "s0")))
        else:
            trans = F.when(m, F.datediff(dates[st], dates[STAGES[i - 1]]))
        if i == 0:
            drop = F.lit(None).cast("int")
            is_drop = F.lit(False)
        else:
            is_drop = members[STAGES[i - 1]] & ~m
            drop = F.when(is_drop, F.datediff("last_ev", dates[STAGES[i - 1]]))
        rows.append(F.struct(F.lit(i).alias("si"), F.lit(st).alias("stage"), m.alias("member"),
                             since.cast("double").alias("since"), trans.cast("double").alias("trans"),
                             is_drop.alias("is_drop"), drop.cast("double").alias("drop")))
    long = c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    agg = long.groupBy("si", "stage").agg(
        F.count_if("member").alias("count"), F.count_if("is_drop").alias("dropoff_customer_count"),
        F.avg("since").alias("avg_s"), F.avg("trans").alias("avg_t"), F.avg("drop").alias("avg_d"))
    # one exact-median pass for all three day measures: (stage, measure) is the group
    kinds = long.select("si", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v"))
                                                 for k in ("since", "trans", "drop")])).alias("x"))
    q = grouped_quantiles(kinds.select("si", "x.kind", "x.v"), "v", [0.5], ["si", "kind"], out_col="m")
    med = q.groupBy("si").agg(*[F.max(F.when(F.col("kind") == k, F.col("m"))).alias(f"med_{k}")
                                 for k in ("since", "trans", "drop")])
    out = small_table(agg.join(med, "si", "left"))   # five rows, read three times below
    # five stage rows: the total and the previous stage's count by tiny broadcast joins
    tot = out.filter(F.col("si") == 0).select(F.col("count").alias("__tot"))
    prevs = out.select((F.col("si") + 1).alias("si"), F.col("count").alias("__prev"))
    out = out.crossJoin(F.broadcast(tot)).join(F.broadcast(prevs), "si", "left")
    prev = F.col("__prev")
    conv = F.col("count") / F.greatest(F.col("__tot"), F.lit(1))
    drop_rate = F.when(F.col("si") == 0, 0.0).otherwise(
        F.when(prev > 0, (prev - F.col("count")) / prev).otherwise(0.0))
    return out.select(
        "stage", "count", F.bround(conv, 4).alias("conversion_rate"), F.bround(drop_rate, 4).alias("drop_off_rate"),
        F.bround("avg_s", 2).alias("avg_days_since_signup"), F.bround("med_since", 2).alias("median_days_since_signup"),
        F.bround("avg_t", 2).alias("avg_days_from_previous_stage"),
        F.bround("med_trans", 2).alias("median_days_from_previous_stage"),
        "dropoff_customer_count",
        F.bround("avg_d", 2).alias("avg_dropoff_days_after_previous_stage"),
        F.bround("med_drop", 2).alias("median_dropoff_days_after_previous_stage"))


def cohort_sizes(customers: DataFrame) -> DataFrame:
    """C20: distinct customers by signup month."""
    return (customers.filter(F.col("signup_date").isNotNull())
            .groupBy(month_label("signup_date").alias("cohort"))
            .agg(F.count_distinct("customer_id").alias("customers")))


# ------------------------------------------------------------------ C21, C22

def mask_unobserved(ret: DataFrame, max_date) -> DataFrame:
    """Null the cells after a cohort's last positive period (all of them if none)
    and the periods whose end ``(p + 1) * 30 - 1`` days after the cohort month start
    lies beyond the last event date."""
    w = Window.partitionBy("cohort")
    last_pos = F.max(F.when(F.col("retention") > 0, F.col("cohort_period"))).over(w)
    start = F.to_date(F.concat(F.col("cohort"), F.lit("-01")))
    end = F.date_add(start, (F.col("cohort_period") + 1) * 30 - 1)
    md = max_date if isinstance(max_date, Column) else F.to_date(F.lit(str(max_date)))
    trail = last_pos.isNull() | (F.col("cohort_period") > last_pos)
    incomplete = end > md
    unobs = trail | F.coalesce(incomplete, F.lit(False))
    return ret.withColumn("unobserved", unobs).withColumn(
        "observed_retention", F.when(~F.col("unobserved"), F.col("retention")))


def final_retention(masked: DataFrame) -> DataFrame:
    """Mean observed value of the last period, else mean of each cohort's deepest
    observed value (0 when nothing is observed)."""
    last_p = masked.agg(F.max("cohort_period").alias("__lp"))
    j = masked.crossJoin(F.broadcast(last_p))
    last_mean = j.filter((F.col("cohort_period") == F.col("__lp")) & ~F.col("unobserved")) \
        .agg(F.avg("observed_retention").alias("a"), F.count(F.lit(1)).alias("n"))
    deepest = (masked.filter(F.col("observed_retention").isNotNull()).groupBy("cohort")
               .agg(F.max_by("observed_retention", "cohort_period").alias("v"))
               .agg(F.avg("v").alias("b")))
    return last_mean.crossJoin(deepest).select(
        F.when(F.col("n") > 0, F.col("a")).otherwise(F.coalesce(F.col("b"), F.lit(0.0))).alias("final_retention"),
        F.when(F.col("n") > 0, F.lit("last_period")).otherwise(F.lit("deepest_observed")).alias("basis"))
