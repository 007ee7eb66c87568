"""Reporting aggregates behind the dashboards.

Each is a grouped aggregate or a tiny-table expression; medians and percentiles come from
the distributed ``grouped_quantiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.prefix import global_order
from churnlens.functions.quantiles import grouped_quantiles


def segment_overview(pred: DataFrame, seg: str = "segment") -> DataFrame:
    """O1: count, mean churn, count with p > .5, mean CLV per segment."""
    return pred.groupBy(seg).agg(F.count(F.lit(1)).alias("customers"),
                                 F.avg("churn_probability").alias("avg_churn_probability"),
                                 F.count_if(F.col("churn_probability") > 0.5).alias("high_risk_customers"),
                                 F.avg("clv").alias("avg_clv"))


def segment_spread(pred: DataFrame, seg: str = "segment") -> DataFrame:
    """O2: count, mean, min, max, sample std of churn probability per segment."""
    p = F.col("churn_probability")
    return pred.groupBy(seg).agg(F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean"), F.min(p).alias("min"),
                                 F.max(p).alias("max"), F.stddev_samp(p).alias("std"))


def segment_analytics(pred: DataFrame, seg: str = "segment") -> DataFrame:
    """O3: mean, median, std, counts above .5 and above .75, share above .5 (percent, 1 digit)."""
    g = pred.groupBy(seg).agg(
        F.count(F.lit(1)).alias("count"), F.avg("churn_probability").alias("mean"),
        F.stddev_samp("churn_probability").alias("std"),
        F.count_if(F.col("churn_probability") > 0.5).alias("high_risk_count"),
        F.count_if(F.col("churn_probability") > 0.75).alias("critical_count"))
    med = grouped_quantiles(pred, "churn_probability", [0.5], [seg]).select(seg, F.col("q").alias("median"))
    return g.join(med, seg, "left").withColumn(
        "high_risk_pct", F.round(F.col("high_risk_count") / F.col("count") * 100.0, 1))


def segment_risk(pred: DataFrame, seg: str = "segment") -> DataFrame:
    """Segment x risk-level counts (with ``cube`` subtotals marked by nulls)."""
    return pred.cube(seg, "risk_level").agg(F.count(F.lit(1)).alias("count"))


def clv_tiers(pred: DataFrame, clv: str = "clv") -> DataFrame:
    """Quartile tiers Platinum (>= q75), Gold (>= q50), Silver (>= q25), Bronze, and stats."""
    q = grouped_quantiles(pred, clv, [0.25, 0.5, 0.75])
    t = q.agg(*[F.max(F.when(F.col("q_index") == i, F.col("q"))).alias(f"__q{i}") for i in range(3)])
    j = pred.crossJoin(F.broadcast(t))
    v = F.col(clv)
    tier = (F.when(v >= F.col("__q2"), "Platinum").when(v >= F.col("__q1"), "Gold")
            .when(v >= F.col("__q0"), "Silver").otherwise("Bronze"))
    return j.withColumn("clv_tier", tier).groupBy("clv_tier").agg(
        F.count(F.lit(1)).alias("count"), F.avg(clv).alias("avg_clv"), F.sum(clv).alias("total_clv"),
        F.avg("churn_probability").alias("avg_churn_probability"))


def clv_by_segment(pred: DataFrame, seg: str = "segment", clv: str = "clv", min_n: int = 5) -> DataFrame:
    """Mean, sum, count, median, std of CLV per segment with at least ``min_n`` customers."""
    g = pred.groupBy(seg).agg(F.avg(clv).alias("mean"), F.sum(clv).alias("sum"), F.count(F.lit(1)).alias("count"),
                              F.stddev_samp(clv).alias("std"))
    med = grouped_quantiles(pred, clv, [0.5], [seg]).select(seg, F.col("q").alias("median"))
    return g.join(med, seg, "left").filter(F.col("count") >= min_n)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}__{b}" for a, b in pairs], "pair", "correlation")
    sp = F.split("pair", "__")
    half = long.select(sp[0].alias("column_a"), sp[1].alias("column_b"), "correlation")
    mirror = half.filter(F.col("column_a") != F.col("column_b")).select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    return half.unionByName(mirror)


def cumulative_importance(imp: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Importance share and running share in decreasing importance (one row per feature:
    the table is bounded by the number of features); shares of a total of 0 are 0."""
    w_all = Window.partitionBy(F.lit(1))
    w = w_all.orderBy(F.desc(value), F.asc(feature)).rowsBetween(Window.unboundedPreceding, 0)
    share = F.coalesce(F.try_divide(F.col(value), F.sum(value).over(w_all)), F.lit(0.0))
    return imp.withColumn("share", share).withColumn("cumulative_share", F.sum(share).over(w))


def uplift_by_segment(u: DataFrame, seg: str = "segment") -> DataFrame:
    """Mean uplift and treatment effect, count, positive uplifts and their percentage per segment."""
    g = u.groupBy(seg).agg(F.avg("uplift_score").alias("avg_uplift"), F.avg("treatment_effect").alias("avg_treatment_effect"),
                           F.count(F.lit(1)).alias("count"), F.count_if(F.col("uplift_score") > 0).alias("persuadable"))
    return g.withColumn("persuadable_pct", F.round(F.col("persuadable") / F.col("count") * 100.0, 1))


# Fixed class names.
RESPONSE_CLASSES = {"persuadable": "Persuadable", "sure_thing": "Sure Thing", "lost_cause": "Lost Cause",
                    "sleeping_dog": "Sleeping Dog"}


def response_class(u: DataFrame, label_col: str | None = "uplift_segment") -> DataFrame:
    """Response class of a known segment label, else by the signs of uplift and treatment effect."""
    up, effect = F.col("uplift_score") > 0, F.col("treatment_effect") > 0
    cls = (F.when(up & effect, "Persuadable").when(~up & effect, "Sure Thing").when(~up & ~effect, "Lost Cause")
           .otherwise("Sleeping Dog"))
    if label_col and label_col in u.columns:
        names = F.create_map(*[F.lit(x) for pair in RESPONSE_CLASSES.items() for x in pair])
        cls = F.coalesce(names[F.col(label_col)], cls)
    return u.withColumn("response_class", cls)


def action_cost(recs: DataFrame) -> DataFrame:
    """Cost per action, and mean cost per mean uplift (at least .001)."""
    g = recs.groupBy("action_type").agg(
        F.sum("estimated_cost").alias("total_cost"), F.avg("estimated_cost").alias("mean_cost"),
        F.count(F.lit(1)).alias("count"), F.avg("uplift_score").alias("mean_uplift"))
    return g.withColumn("cost_per_uplift", F.col("mean_cost") / F.greatest(F.col("mean_uplift"), F.lit(0.001)))


def offer_roi(offers: DataFrame, by: str = "offer_type") -> DataFrame:
    """Cost, revenue and revenue / max(cost, 1)."""
    g = offers.groupBy(by).agg(F.sum("estimated_cost_krw").alias("cost"),
                               F.sum("expected_revenue_saved_krw").alias("revenue"), F.count(F.lit(1)).alias("offers"))
    return g.withColumn("roi", F.col("revenue") / F.greatest(F.col("cost"), F.lit(1.0)))


def top_n(df: DataFrame, col: str, n: int = 10, id_col: str = "customer_id") -> DataFrame:
    """Top-n rows (TakeOrderedAndProject: a bounded top-k per partition, then a merge)."""
    return df.orderBy(F.desc(col), F.asc(id_col)).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def kpi_delta(series: DataFrame, period: str, value: str) -> DataFrame:
    """% change vs the previous period (1 dp) over a tiny per-period series; counts floored."""
    w = Window.partitionBy(F.lit(1)).orderBy(period)
    prev = F.lag(value).over(w)
    return series.withColumn("value_int", F.floor(value)).withColumn(
        "pct_change", F.round(F.try_divide(F.col(value) - prev, prev) * 100.0, 1))


def enrich(pred: DataFrame, offers: DataFrame, features: DataFrame, clv: DataFrame) -> DataFrame:
    """Left joins of offers, features and CLV; one offer per customer (highest priority);
    defaults for missing values."""
    o = offers.groupBy("customer_id").agg(
        F.max_by(F.struct("offer_type", "estimated_cost_krw"), F.struct("priority_score", "offer_type")).alias("__o")
    ).select("customer_id", "__o.offer_type", "__o.estimated_cost_krw")
    out = (pred.join(o.select("customer_id", "offer_type", "estimated_cost_krw"), "customer_id", "left")
           .join(features, "customer_id", "left")
           .join(clv.select("customer_id", F.col("clv").alias("clv_predicted")), "customer_id", "left"))
    return (out.withColumn("offer_type", F.coalesce("offer_type", F.lit("no_action")))
            .withColumn("estimated_cost_krw", F.coalesce("estimated_cost_krw", F.lit(0.0)))
            .withColumn("clv_predicted", F.coalesce("clv_predicted", F.lit(0.0))))


# Default cost per recommendation type when a frame carries none
# (unknown types cost 1000).
DEFAULT_ACTION_COSTS = {"email": 1000, "push_notification": 500, "coupon": 5000, "loyalty_points": 3000,
                        "personal_outreach": 20000, "exclusive_offer": 10000, "no_action": 0}
DEFAULT_ACTION_COST = 1000


def _first(df: DataFrame, names) -> str | None:
    return next((c for c in names if c in df.columns), None)


def adapt_budget(df: DataFrame) -> DataFrame:
    """O17 (budget): ``segment, allocated_budget_krw, expected_retained,
    expected_revenue_saved_krw, roi`` derived from whichever aliases the frame has.

    roi = revenue / spend with a zero spend (or a missing side) giving 0; a customer-level
    frame counts one retained customer per row and is the segment ``all_customers``; a
    frame with neither segment nor customer id gets ``scenario_<row>`` in its id order.
    """
    cols = {}
    spend = _first(df, ("allocated_budget_krw", "allocated_budget"))
    cols["allocated_budget_krw"] = F.col(spend) if spend else None
    rev = _first(df, ("expected_revenue_saved_krw", "expected_revenue_saved", "retained_value",
                      "expected_retained_value"))
    cols["expected_revenue_saved_krw"] = F.col(rev) if rev else None
    ret = _first(df, ("expected_retained", "customers_treated"))
    cols["expected_retained"] = F.col(ret) if ret else (F.lit(1) if "customer_id" in df.columns else None)
    if "roi" in df.columns:
        cols["roi"] = F.col("roi")
    elif spend and rev:
        cols["roi"] = F.coalesce(F.try_divide(F.col(rev), F.nullif(F.col(spend).cast("double"), F.lit(0.0))),
                                 F.lit(0.0))
    else:
        cols["roi"] = F.lit(0.0)
    if "segment" in df.columns:
        seg = F.col("segment")
    elif "customer_id" in df.columns:
        seg = F.lit("all_customers")
    else:
        df = global_order(df.withColumn("__at", F.monotonically_increasing_id()), [("__at", True)], rank_col="__no")
        seg = F.concat(F.lit("scenario_"), F.col("__no").cast("string"))
    out = [seg.alias("segment")]
    for c in ("allocated_budget_krw", "expected_retained", "expected_revenue_saved_krw", "roi"):
        out.append((cols[c] if cols[c] is not None else F.lit(0.0)).alias(c))
    return df.select(*out)


def adapt_recommendations(df: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """O17 (recommendations): ``recommendation_type`` from action aliases, priority from
    ``score``, expected uplift from ``uplift_score``, default costs by type, missing
    segments from a (customer_id, segment) table else ``vip_loyal``; priority and uplift
    clipped to [0, 1]."""
    out = df
    if "recommendation_type" not in out.columns:
        src = _first(out, ("action", "action_type"))
        out = out.withColumn("recommendation_type", F.col(src) if src else F.lit(None).cast("string"))
    if "priority_score" not in out.columns:
        out = out.withColumn("priority_score", F.col("score") if "score" in out.columns else F.lit(0.0))
    if "expected_uplift" not in out.columns:
        out = out.withColumn("expected_uplift", F.col("uplift_score") if "uplift_score" in out.columns
                             else F.col("priority_score"))
    if "recommended_offer" not in out.columns:
        out = out.withColumn("recommended_offer", F.col("recommendation_type").cast("string"))
    if "estimated_cost" not in out.columns:
        m = F.create_map(*[x for k, v in DEFAULT_ACTION_COSTS.items() for x in (F.lit(k), F.lit(float(v)))])
        out = out.withColumn("estimated_cost", F.coalesce(
            m[F.col("recommendation_type").cast("string")], F.lit(float(DEFAULT_ACTION_COST))))
    if "segment" not in out.columns:
        if segments is not None and "customer_id" in out.columns:
            out = out.join(segments.select("customer_id", "segment"), "customer_id", "left")
            out = out.withColumn("segment", F.coalesce("segment", F.lit("vip_loyal")))
        else:
            out = out.withColumn("segment", F.lit("vip_loyal"))
    clip = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("priority_score", clip("priority_score")) \
        .withColumn("expected_uplift", clip("expected_uplift"))


def kpi_header(pred: DataFrame) -> DataFrame:
    """Customers, churn rate, mean and median probability, high / critical counts, CLV."""
    a = pred.agg(F.count(F.lit(1)).alias("customers"),
                 F.avg((F.col("churn_probability") >= 0.5).cast("double")).alias("predicted_churn_rate"),
                 F.avg("churn_probability").alias("mean_probability"),
                 F.count_if(F.col("risk_level") == "high").alias("high_risk"),
                 F.count_if(F.col("risk_level") == "critical").alias("critical_risk"),
                 F.sum("clv").alias("total_clv"))
    med = grouped_quantiles(pred, "churn_probability", [0.5]).select(F.col("q").alias("median_probability"))
    return a.crossJoin(med)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bin counts over [min, max] (last bin closed), densified with 0."""
    mm = df.agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    j = df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(mm))
    rng = F.col("__mx") - F.col("__mn")
    b = F.when(rng > 0, F.least(F.floor((F.col(col) - F.col("__mn")) / rng * bins), F.lit(bins - 1))).otherwise(0)
    cnt = j.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = mm.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "__mn", "__mx")
    w = (F.col("__mx") - F.col("__mn")) / bins
    return (grid.join(cnt, "bin", "left").na.fill(0, ["count"])
            .select("bin", (F.col("__mn") + F.col("bin") * w).alias("bin_start"),
                    (F.col("__mn") + (F.col("bin") + 1) * w).alias("bin_end"), "count"))


def clv_percentiles(pred: DataFrame, clv: str = "clv", probs=(0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """CLV percentile table."""
    return grouped_quantiles(pred, clv, list(probs)).select(
        (F.round(F.col("prob") * 100)).cast("int").alias("percentile"), F.col("q").alias("value"))


def at_risk_revenue(pred: DataFrame) -> DataFrame:
    """CLV of customers with p > .5 and its share."""
    return pred.agg(F.sum(F.when(F.col("churn_probability") > 0.5, F.col("clv")).otherwise(0.0)).alias("at_risk_clv"),
                    F.sum("clv").alias("total_clv")) \
        .withColumn("at_risk_share", F.try_divide(F.col("at_risk_clv"), F.col("total_clv")))


def cost_per_retained(summary: DataFrame) -> DataFrame:
    """Allocation / expected retained (0 when nothing is retained)."""
    return summary.withColumn("cost_per_retained", F.when(F.col("expected_retained") > 0,
                                                          F.col("allocated_budget") / F.col("expected_retained"))
                              .otherwise(0.0))


def rescale_budget(summary: DataFrame, scale: float, uplift_mult: float = 1.0, cost_mult: float = 1.0) -> DataFrame:
    """Budget scaled and truncated to an integer; ROI scaled by uplift / cost (2 dp)."""
    return (summary.withColumn("scaled_budget", (F.col("allocated_budget") * scale).cast("long"))
            .withColumn("scaled_roi", F.round(F.col("roi") * uplift_mult / cost_mult, 2)))


def volume_profile(hourly: DataFrame, ts: str = "hour", n: str = "requests") -> DataFrame:
    """Coefficient of variation < 0.05 flag (>= 5 buckets), the last-24-bucket sum and a
    mean +- std band floored at 0; the series has one row per hour."""
    last = hourly.orderBy(F.desc(ts)).limit(24).agg(F.sum(n).alias("last_24_sum"))
    s = hourly.agg(F.count(F.lit(1)).alias("buckets"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"))
    cv = F.try_divide(F.col("std"), F.col("mean"))
    return s.crossJoin(last).select(
        "buckets", "mean", "std", cv.alias("cv"), ((F.col("buckets") >= 5) & (cv < 0.05)).alias("flat_volume"),
        "last_24_sum", F.greatest(F.col("mean") - F.col("std"), F.lit(0.0)).alias("band_low"),
        (F.col("mean") + F.col("std")).alias("band_high"))


def survival_header(surv: DataFrame) -> DataFrame:
    """Event rate, median and max duration, censoring ratio = median / max."""
    a = surv.agg(F.avg(F.col("event").cast("double")).alias("event_rate"), F.max("duration").alias("max_duration"))
    med = grouped_quantiles(surv, "duration", [0.5]).select(F.col("q").alias("median_duration"))
    return a.crossJoin(med).withColumn("censoring_ratio", F.try_divide(F.col("median_duration"),
                                                                       F.col("max_duration")))

