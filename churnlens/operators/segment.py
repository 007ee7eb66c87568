"""Segmentation: RFM quantile scores, rule segments, k-means segments, value x uplift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import col
from churnlens.functions.prefix import global_order
from churnlens.functions.quantiles import quantile, quantiles
from churnlens.session import cut_lineage

# Rule segments in priority order, criteria as
# (recency min, recency max, frequency min, frequency max, monetary min, monetary max),
# None = no bound, and the retention action per segment.
SEGMENT_RULES = (
    ("vip_loyal", (4, None, 4, None, 4, None), "exclusive_rewards",
     "Top-tier customers with highest RFM scores"),
    ("loyal_customer", (3, None, 4, None, 2, None), "loyalty_program",
     "Consistent buyers with strong frequency"),
    ("potential_loyalist", (4, None, 2, None, 2, None), "engagement_campaign",
     "Recent customers with growing engagement"),
    ("at_risk", (None, 2, 3, None, 2, None), "win_back_campaign",
     "Previously active customers showing decline"),
    ("hibernating", (None, 2, None, 2, 1, None), "reactivation_offer",
     "Low recency, low frequency customers"),
    ("explorer", (4, None, None, 1, None, 2), "onboarding_sequence",
     "Recently acquired with limited history"),
    ("new_customer", (None, 3, 2, None, 4, None), "premium_win_back",
     "Newly registered customers"),
    ("bargain_hunter", (2, None, 3, None, None, 2), "targeted_promotion",
     "Frequent low-value buyers driven by promotions"),
)
DEFAULT_ACTION = "general"
SCORE_COLS = ("recency_score", "frequency_score", "monetary_score")


def quantile_score(df: DataFrame, value_col: str, q: int = 5, inverse: bool = False,
                   out_col: str | None = None, id_col: str = "customer_id",
                   stats: tuple[int, int] | None = None) -> DataFrame:
    """G1: pandas ``qcut(rank(method='first'), q)`` labels, exactly.

    rank r in 1..n by (value, id); bin = max(1, ceil((r - 1) * q / (n - 1))) in integer
    arithmetic; inverse labels are ``q + 1 - bin``; one distinct value gives q (1 if inverse).
    ``stats`` = (row count, distinct values) when the caller already has them.
    """
    out_col = out_col or f"{value_col}_score"
    if stats is None:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value_col).alias("d")).first()
        stats = (int(r["n"]), int(r["d"] or 0))
    n, d = stats
    if d <= 1:
        return df.withColumn(out_col, F.lit(1 if inverse else q))
    ranked = global_order(df, [(value_col, True), (id_col, True)], rank_col="__r")
    bin_ = F.greatest(F.lit(1), F.expr(f"((__r - 1) * {q} + {n - 2}) div {n - 1}"))
    label = (F.lit(q + 1) - bin_) if inverse else bin_
    return ranked.withColumn(out_col, label.cast("int")).drop("__r")


def rfm_scores(rfm: DataFrame, q: int = 5, id_col: str = "customer_id") -> DataFrame:
    """Recency (inverse), frequency, monetary quantile scores (G1 of each).

    The three measures are ranked in one global order of (measure, value, id).
    """
    cols = ("recency", "frequency", "monetary")
    r = rfm.agg(F.count(F.lit(1)).alias("n"), *[(F.count(c) > 0) & (F.min(c) != F.max(c)) for c in cols]).first()
    n = int(r["n"])
    varied = [c for c, v in zip(cols, r[1:]) if v]
    label = {c: F.lit(1 if c == "recency" else q) for c in cols}
    out = rfm
    if varied:
        long = rfm.select(id_col, F.explode(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in varied])).alias("x"))
        ranked = global_order(long.select(id_col, "x.measure", "x.v"), [("v", True), (id_col, True)],
                              partition_by=["measure"], rank_col="__r")
        bin_ = F.greatest(F.lit(1), F.expr(f"((__r - 1) * {q} + {n - 2}) div {n - 1}"))
        bins = ranked.groupBy(id_col).agg(*[F.max(F.when(F.col("measure") == c, bin_)).alias(f"__{c}") for c in varied])
        out = rfm.join(bins, id_col)
        for c in varied:
            label[c] = F.lit(q + 1) - F.col(f"__{c}") if c == "recency" else F.col(f"__{c}")
    return out.select(*rfm.columns, *[label[c].cast("int").alias(f"{c}_score") for c in cols])


def _rule_match(bounds) -> Column:
    cond = F.lit(True)
    for c, (lo, hi) in zip(SCORE_COLS, zip(bounds[0::2], bounds[1::2])):
        if lo is not None:
            cond = cond & (F.col(c) >= lo)
        if hi is not None:
            cond = cond & (F.col(c) <= hi)
    return cond


def rule_segment_expr(rules=SEGMENT_RULES) -> Column:
    """First matching rule in priority order; null when none matches."""
    expr = None
    for name, bounds, *_ in rules:
        expr = F.when(_rule_match(bounds), F.lit(name)) if expr is None \
            else expr.when(_rule_match(bounds), F.lit(name))
    return expr


def rule_segments(scored: DataFrame, rules=SEGMENT_RULES) -> DataFrame:
    return scored.withColumn("segment", rule_segment_expr(rules))


def fallback_segments(seg: DataFrame) -> DataFrame:
    """Unmatched rows take the segment of the nearest mean score vector.

    Centroids are one row per rule (bounded by the rule list), so they are computed by
    one aggregate, brought to the driver and written into the expression; ties go to
    the alphabetically first segment; no assigned row at all gives ``other``.
    """
    cents = (seg.filter(F.col("segment").isNotNull()).groupBy("segment")
             .agg(*[F.avg(c).alias(c) for c in SCORE_COLS]).collect())
    cents = sorted(cents, key=lambda r: r["segment"])
    if not cents:
        return seg.withColumn("segment", F.coalesce("segment", F.lit("other")))
    dists = [sum((F.col(c).cast("double") - F.lit(float(r[c]))) ** 2 for c in SCORE_COLS)
             for r in cents]
    best = F.least(*dists) if len(dists) > 1 else dists[0]
    nearest = F.coalesce(*[F.when(d == best, F.lit(r["segment"])) for d, r in zip(dists, cents)])
    return seg.withColumn("segment", F.coalesce(F.col("segment"), nearest))


def rfm_segments(rfm: DataFrame, q: int = 5) -> DataFrame:
    """G2 + G3 + G4. The scored per-customer table is checkpointed once: the centroid
    aggregate and every consumer read it instead of re-running the three rankings."""
    return fallback_segments(cut_lineage(rule_segments(rfm_scores(rfm, q))))


def segment_summary(seg: DataFrame) -> DataFrame:
    """Count, percentage and means of the available value columns per segment."""
    optional = ["recency", "frequency", "monetary", "churn_probability", "uplift_score",
                "predicted_clv", "clv", "priority_score"]
    aggs = [F.count(F.lit(1)).alias("count")] + \
        [F.avg(c).alias(f"avg_{c}") for c in optional if c in seg.columns]
    by = seg.groupBy("segment").agg(*aggs)
    total = seg.agg(F.count(F.lit(1)).alias("__total"))
    meta = seg.sparkSession.createDataFrame(
        [(name, desc) for name, _, _, desc in SEGMENT_RULES], "segment string, description string")
    return (by.crossJoin(F.broadcast(total))
            .withColumn("percentage", F.col("count") / F.col("__total") * 100.0)
            .drop("__total")
            .join(F.broadcast(meta), "segment", "left")
            .withColumn("description", F.coalesce("description", F.lit(""))))


def retention_actions(seg: DataFrame, rules=SEGMENT_RULES) -> DataFrame:
    """Segment -> action, ``general`` when unknown."""
    m = seg.sparkSession.createDataFrame([(r[0], r[2]) for r in rules],
                                         "segment string, retention_action string")
    return (seg.select("customer_id", "segment").join(F.broadcast(m), "segment", "left")
            .withColumn("retention_action", F.coalesce("retention_action", F.lit(DEFAULT_ACTION)))
            .select("customer_id", "segment", "retention_action"))


# Fixed names that must equal the reference's, best cluster first.
CLUSTER_NAMES = ("vip_loyal", "loyal_customer", "potential_loyalist", "at_risk", "hibernating", "explorer",
                 "new_customer", "bargain_hunter")


def _average_ranks(values: dict, ascending: bool = True) -> dict:
    """1-based ranks; equal values share the mean of their places."""
    ordered = sorted(values.values(), reverse=not ascending)
    return {k: (2 * ordered.index(v) + ordered.count(v) + 1) / 2 for k, v in values.items()}


def cluster_names(means: dict) -> dict:
    """Names by the rank of -rank(R) + rank(F) + rank(M) over the clusters' mean (R, F, M)."""
    ranks = [_average_ranks({c: m[j] for c, m in means.items()}) for j in range(3)]
    place = _average_ranks({c: -ranks[0][c] + ranks[1][c] + ranks[2][c] for c in means}, ascending=False)
    return {c: CLUSTER_NAMES[min(int(p) - 1, len(CLUSTER_NAMES) - 1)] for c, p in place.items()}


def kmeans_segments(rfm: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """G5 + G6: standardised R, F, M -> k-means, clusters named by centroid rank.

    Names by ``cluster_names``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    cols = ["recency", "frequency", "monetary"]
    va = VectorAssembler(inputCols=cols, outputCol="__raw", handleInvalid="keep")
    x = va.transform(rfm.na.fill(0.0, cols))
    sc = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True).fit(x)
    x = sc.transform(x)
    n = rfm.count()
    model = KMeans(k=max(1, min(k, n)), seed=seed, featuresCol="features",
                   predictionCol="cluster").fit(x)
    out = model.transform(x).drop("__raw", "features")
    # Clusters without a row are no candidates; means are those of the rows' own R, F, M.
    means = {r["cluster"]: r for r in out.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols]).collect()}   # k rows
    names = cluster_names({c: tuple(r[x] for x in cols) for c, r in means.items()})
    mapping = F.create_map(*[x for cl, nm in names.items() for x in (F.lit(cl), F.lit(nm))])
    return out.withColumn("segment", mapping[F.col("cluster")])


# ---------------------------------------------------------------- value x uplift

def value_uplift_segments(df: DataFrame, churn_col: str = "churn_probability",
                          uplift_col: str = "uplift_score", clv_col: str = "clv",
                          tenure_col: str | None = "tenure_days", high_value_q: float = 0.8,
                          high_churn: float = 0.5, neutral_band: float = 0.05,
                          onboarding_days: float = 30) -> DataFrame:
    """Two-tier value x uplift segments with onboarding first."""
    thr = quantile(df, clv_col, high_value_q)
    clv, churn, up = col(clv_col), col(churn_col), col(uplift_col)
    tier = F.when(clv >= F.lit(thr), "high_value").otherwise("low_value")
    uclass = (F.when(up < 0, "sleeping_dog").when(F.abs(up) <= neutral_band, "neutral")
              .otherwise("persuadable"))
    out = (df.withColumn("value_tier", tier)
           .withColumn("high_value", F.col("value_tier") == "high_value")
           .withColumn("high_churn", churn >= high_churn)
           .withColumn("positive_uplift", up > 0)
           .withColumn("uplift_class", uclass)
           .withColumn("priority_score", up * clv))
    seg = (F.when(F.col("uplift_class") == "sleeping_dog", "sleeping_dog")
           .when((F.col("uplift_class") == "persuadable") & F.col("high_churn"),
                 F.concat(F.col("value_tier"), F.lit("_persuadable")))
           .when(F.col("high_churn"), F.concat(F.col("value_tier"), F.lit("_lost_cause")))
           .otherwise(F.concat(F.col("value_tier"), F.lit("_sure_thing"))))
    if tenure_col and tenure_col in df.columns:
        seg = F.when(col(tenure_col) <= onboarding_days, "new_customer_onboarding").otherwise(seg)
    return out.withColumn("segment", seg)


def pipeline_value_segments(df: DataFrame, churn_col: str = "churn_probability",
                            uplift_col: str = "uplift_score", clv_col: str = "clv") -> DataFrame:
    """Three tiers at the 80% and 40% CLV quantiles; lost cause / sure thing first."""
    hi, mid = quantiles(df, clv_col, [0.8, 0.4])
    clv, churn, up = col(clv_col), col(churn_col), col(uplift_col)
    tier = (F.when(clv >= F.lit(hi), "high_value").when(clv >= F.lit(mid), "mid_value")
            .otherwise("low_value"))
    out = (df.withColumn("value_tier", tier)
           .withColumn("high_value", F.col("value_tier") == "high_value")
           .withColumn("high_churn", churn >= 0.5)
           .withColumn("positive_uplift", up > 0)
           .withColumn("priority_score", up * clv))
    hv, hc = F.col("high_value"), F.col("high_churn")
    seg = (F.when(hv & hc & (up <= 0), "high_value_lost_cause")
           .when(hv & ~hc & (up <= 0), "high_value_sure_thing")
           .when(up < 0, "sleeping_dog")
           .when(hc & F.col("positive_uplift"), F.concat(F.col("value_tier"), F.lit("_persuadable")))
           .when(hc, F.concat(F.col("value_tier"), F.lit("_lost_cause")))
           .otherwise(F.concat(F.col("value_tier"), F.lit("_sure_thing"))))
    return out.withColumn("segment", seg)


def segment_evidence(seg: DataFrame, churn_col: str = "churn_probability",
                     uplift_col: str = "uplift_score", high_churn: float = 0.5) -> DataFrame:
    """One-row evidence report of high-value actionable segments."""
    hv = F.col("high_value")
    hc = col(churn_col) >= high_churn
    pos = col(uplift_col) > 0
    per = F.col("segment") == "high_value_persuadable"
    lost = F.col("segment") == "high_value_lost_cause"
    rep = seg.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(hv).alias("high_value_count"),
        F.count_if(hc).alias("high_risk_count"),
        F.count_if(pos).alias("positive_uplift_count"),
        F.count_if(per).alias("high_value_persuadable_count"),
        F.count_if(lost).alias("high_value_lost_cause_count"),
        F.count_if(per | lost).alias("high_value_actionable_count"),
        F.count_if(hv & hc & pos).alias("high_value_at_risk_positive_uplift_count"),
        F.count_if(hv & hc & ~pos).alias("high_value_at_risk_nonpositive_uplift_count"),
    )
    reason = F.when(F.col("high_value_actionable_count") > 0, F.lit(None)).otherwise(F.lit(
        "No high-value customers met persuadable or lost-cause criteria under the configured "
        "churn/uplift/CLV thresholds."))
    return (rep.withColumn("absence_reason", reason)
            .withColumn("valid", F.lit(True))
            .withColumn("validity_reason",
                        F.when(F.col("high_value_actionable_count") > 0,
                               "high_value_actionable_evidence_present")
                        .otherwise("structured_absence_report_present")))


def segment_evidence_samples(seg: DataFrame, n: int = 20) -> DataFrame:
    """G10 samples: top-n actionable rows by priority (a top-k report)."""
    act = seg.filter(F.col("segment").isin("high_value_persuadable", "high_value_lost_cause"))
    return act.orderBy(F.desc("priority_score"), F.asc("customer_id")).limit(n)
