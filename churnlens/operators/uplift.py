"""Uplift modelling and evaluation.

Learners are Spark ML classifiers. AUUC, Qini and the cumulative uplift curve are
prefix sums in score order (``global_order``); the trapezoid over i/n telescopes to
``(sum(u) - (u_1 + u_n) / 2) / n`` so no lag window is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.prefix import global_order
from churnlens.functions.quantiles import quantile
from churnlens.operators.models import stratified_folds
from churnlens.session import cut_lineage


def _gbt(features, seed=42):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            GBTClassifier(labelCol="label", seed=seed, maxIter=20, maxDepth=3)])


def _p(model, df, name):
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).select("customer_id", vector_to_array("probability")[1].alias(name))


def uplift_t(df: DataFrame, features: list[str], label: str = "churn_label", treat: str = "is_treatment",
             score: DataFrame | None = None) -> DataFrame:
    """T-learner; uplift = P(churn | control) - P(churn | treated). Fitted on ``df``, applied to
    ``score`` (default: the same rows)."""
    d = df.withColumn("label", F.col(label).cast("double"))
    if score is None:
        d = cut_lineage(d)      # both fits and both scorings read the rows: their joins run once
    mt = _gbt(features).fit(d.filter(F.col(treat) == 1))
    mc = _gbt(features).fit(d.filter(F.col(treat) == 0))
    rows = d if score is None else score
    return (_p(mc, rows, "p_control").join(_p(mt, rows, "p_treated"), "customer_id")
            .withColumn("uplift_score", F.col("p_control") - F.col("p_treated")))


def uplift_s(df: DataFrame, features: list[str], label: str = "churn_label", treat: str = "is_treatment",
             score: DataFrame | None = None) -> DataFrame:
    """S-learner; one model with the treatment flag, applied with 0 and with 1."""
    d = df.withColumn("label", F.col(label).cast("double")).withColumn("__t", F.col(treat).cast("double"))
    if score is None:
        d = cut_lineage(d)
    m = _gbt(features + ["__t"]).fit(d)
    rows = d if score is None else score
    return (_p(m, rows.withColumn("__t", F.lit(0.0)), "p_control")
            .join(_p(m, rows.withColumn("__t", F.lit(1.0)), "p_treated"), "customer_id")
            .withColumn("uplift_score", F.col("p_control") - F.col("p_treated")))


LEARNERS = {"t_learner": uplift_t, "s_learner": uplift_s}


def uplift_folds(df: DataFrame, k: int = 5, label: str = "churn_label", treat: str = "is_treatment", seed: int = 42) -> DataFrame:
    """Folds stratified by arm and label: every fold has its share of each."""
    return stratified_folds(df, [treat, label], k, seed)


def cross_fit_uplift(df: DataFrame, features: list[str], learner: str = "t_learner", k: int = 5, label: str = "churn_label",
                     treat: str = "is_treatment", seed: int = 42) -> DataFrame:
    """U1 / U2 out of fold: each customer scored by models that were fitted without its fold.

    Rows without a label or an arm are left out. Every fold's complement needs customers of both arms.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(treat).isNotNull()).select("customer_id", label, treat, *features)
    # Each fit and each scoring reads the folds: cut the lineage once.
    data = cut_lineage(uplift_folds(rows.na.fill(0.0, features), k, label, treat, seed))
    arms = {(r["fold"], r[treat]): r["count"] for r in data.groupBy("fold", treat).count().collect()}       # 2 k rows
    out = None
    for fold in range(k):
        if any(not sum(n for (f, a), n in arms.items() if a == arm and f != fold) for arm in (0, 1)):
            raise ValueError("every training part needs customers of both arms")
        part = LEARNERS[learner](data.filter(F.col("fold") != fold), features, label, treat, data.filter(F.col("fold") == fold))
        part = part.withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out


def compare_fitted_learners(df: DataFrame, features: list[str], learners: tuple = ("t_learner", "s_learner"), k: int = 5,
                            label: str = "churn_label", treat: str = "is_treatment") -> DataFrame:
    """AUUC, mean, std and positive rate of the learners' out-of-fold scores."""
    truth = df.select("customer_id", label, treat)
    long = None
    for name in learners:
        scores = cross_fit_uplift(df, features, name, k, label, treat).select("customer_id", F.col("uplift_score").alias("uplift"))
        part = scores.join(truth, "customer_id").withColumn("learner", F.lit(name))
        long = part if long is None else long.unionByName(part)
    return compare_long(cut_lineage(long), "uplift", label, treat)


def _curve(df: DataFrame, score: str, y: str, t: str, part: list[str] | None = None) -> DataFrame:
    d = df.select(*(part or []), "customer_id", F.col(score).cast("double").alias("__s"),
                  F.col(y).cast("double").alias("__y"), F.col(t).cast("double").alias("__t"))
    d = d.withColumn("__yt", F.col("__y") * F.col("__t")).withColumn("__yc", F.col("__y") * (1 - F.col("__t"))) \
        .withColumn("__c", 1 - F.col("__t"))
    return global_order(d, [("__s", False), ("customer_id", True)], partition_by=part or [],
                        sums={"cyt": "__yt", "cyc": "__yc", "ct": "__t", "cc": "__c"}, rank_col="k")


def auuc(df: DataFrame, score: str = "uplift_score", y: str = "churn_label", t: str = "is_treatment",
         part: list[str] | None = None) -> DataFrame:
    """Area under the uplift curve u_k = control rate - treated rate of the top k
    (counts floored at 1), trapezoid over k / n; 0 when an arm is empty."""
    c = _curve(df, score, y, t, part)
    u = F.col("cyc") / F.greatest(F.col("cc"), F.lit(1.0)) - F.col("cyt") / F.greatest(F.col("ct"), F.lit(1.0))
    g = c.withColumn("u", u).groupBy(*(part or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("su"), F.min_by("u", "k").alias("u1"),
        F.max_by("u", "k").alias("un"), F.sum("__t").alias("nt"))
    val = (F.col("su") - (F.col("u1") + F.col("un")) / 2) / F.col("n")
    return g.select(*(part or []), F.when((F.col("nt") == 0) | (F.col("nt") == F.col("n")), 0.0).otherwise(val)
                    .alias("auuc"))


def qini_curve(df: DataFrame, score: str = "uplift_score", y: str = "churn_label", t: str = "is_treatment") -> DataFrame:
    """U4: qini_k = control positives x (treated / control counts) - treated positives."""
    c = _curve(df, score, y, t)
    ratio = F.when(F.col("cc") > 0, F.col("ct") / F.col("cc")).otherwise(0.0)
    n = c.agg(F.count(F.lit(1)).alias("__n"))
    return c.crossJoin(F.broadcast(n)).select(
        "customer_id", "k", (F.col("k") / F.col("__n")).alias("fraction"),
        (F.col("cyc") * ratio - F.col("cyt")).alias("qini"))


def compare_learners(df: DataFrame, learners: list[str], y: str = "churn_label", t: str = "is_treatment") -> DataFrame:
    """AUUC, mean, std and positive rate of several uplift score columns (union, then
    the learner is the partition key of one prefix pass)."""
    long = None
    for s in learners:
        part = df.select("customer_id", F.lit(s).alias("learner"), F.col(s).cast("double").alias("uplift"), y, t)
        long = part if long is None else long.unionByName(part)
    return compare_long(long, "uplift", y, t)


def compare_long(long: DataFrame, uplift: str = "uplift", y: str = "churn_label", t: str = "is_treatment") -> DataFrame:
    """U5 on a long table (learner, customer_id, uplift, outcome, arm)."""
    a = auuc(long, uplift, y, t, ["learner"])
    st = long.groupBy("learner").agg(F.avg(uplift).alias("mean_uplift"), F.stddev_pop(uplift).alias("std_uplift"),
                                     F.avg((F.col(uplift) > 0).cast("double")).alias("positive_rate"))
    return a.join(st, "learner")


def uplift_segments(df: DataFrame, uplift: str = "uplift_score", churn: str = "churn_probability",
                    neutral: float = 0.05, high_churn: float = 0.5) -> DataFrame:
    """Any negative uplift is a sleeping dog; at high churn, uplift above the neutral band is
    persuadable and uplift within it a lost cause; the rest is a sure thing."""
    u, c = F.col(uplift), F.col(churn)
    seg = (F.when(u < 0, "sleeping_dog").when((u > neutral) & (c >= high_churn), "persuadable")
           .when((u <= neutral) & (c >= high_churn), "lost_cause").otherwise("sure_thing"))
    return df.withColumn("uplift_segment", seg)


def uplift_segments_median(df: DataFrame, uplift: str = "uplift_score") -> DataFrame:
    """Without churn, the sign of the uplift and its median split the four classes: the
    positive half at max(median, 0), the negative half at min(median, 0)."""
    med = quantile(df, uplift, 0.5) or 0.0
    u = F.col(uplift)
    seg = (F.when(u >= max(med, 0.0), "persuadable").when(u >= 0, "sure_thing")
           .when(u >= min(med, 0.0), "lost_cause").otherwise("sleeping_dog"))
    return df.withColumn("uplift_segment", seg)


def persuadable_lift(df: DataFrame, features: list[str], segment_col: str = "uplift_segment", k: int = 10) -> DataFrame:
    """U8: mean of each feature for persuadables and the rest (0 for an empty side), their
    difference as lift, and the k features of the largest absolute lift."""
    is_p = F.col(segment_col) == "persuadable"
    long = df.select(is_p.alias("__p"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("x"))
    mean = lambda rows: F.coalesce(F.avg(F.when(rows, F.col("x.v"))), F.lit(0.0))
    g = long.groupBy("x.feature").agg(mean(F.col("__p")).alias("persuadable_mean"),
                                      mean(~F.col("__p")).alias("non_persuadable_mean"))
    g = g.withColumn("lift", F.col("persuadable_mean") - F.col("non_persuadable_mean"))
    return g.withColumn("abs_lift", F.abs("lift")).orderBy(F.desc("abs_lift"), F.asc("feature")).limit(k)


def persuadable_customers(df: DataFrame, segment_col: str = "uplift_segment", uplift: str = "uplift_score",
                          churn: str = "churn_probability") -> DataFrame:
    """U8: the persuadables with their rank by uplift (ties by id)."""
    p = df.filter(F.col(segment_col) == "persuadable").select("customer_id", uplift, churn)
    return global_order(p, [(uplift, False), ("customer_id", True)], rank_col="rank")


def persuadable_summary(df: DataFrame, segment_col: str = "uplift_segment", uplift: str = "uplift_score",
                        churn: str = "churn_probability") -> DataFrame:
    """U8: number, share, mean uplift and mean baseline churn of the persuadables."""
    is_p = F.col(segment_col) == "persuadable"
    mean = lambda c: F.avg(F.when(is_p, F.col(c)))
    return df.agg(F.count(F.lit(1)).alias("total_customers"), F.count_if(is_p).alias("persuadable_count"),
                  F.coalesce(F.avg(F.coalesce(is_p, F.lit(False)).cast("double")), F.lit(0.0)).alias("persuadable_rate"),
                  F.coalesce(mean(uplift), F.lit(0.0)).alias("persuadable_mean_uplift"),
                  mean(churn).alias("persuadable_mean_baseline_churn"))


def persona_effect(customers: DataFrame, label: str = "churn_label") -> DataFrame:
    """Empirical effect = control churn rate - treated churn rate per persona."""
    y = F.col(label).cast("double")
    g = customers.groupBy("persona").agg(
        F.avg(F.when(F.col("treatment_group") == "control", y)).alias("control_rate"),
        F.avg(F.when(F.col("treatment_group") == "treatment", y)).alias("treatment_rate"))
    return g.withColumn("empirical_effect", F.col("control_rate") - F.col("treatment_rate"))


def persona_calibrated(df: DataFrame, customers: DataFrame, uplift: str = "uplift_score", label: str = "churn_label") -> DataFrame:
    """Degenerate scores (no spread, or all or none positive) become 0.7 times the persona's
    effect (0 for a persona without both arms) plus 0.3 times the score."""
    s = df.agg(F.stddev_pop(uplift).alias("__sd"), F.avg((F.col(uplift) > 0).cast("double")).alias("__pos"))
    any_effect = persona_effect(customers, label).filter("empirical_effect IS NOT NULL")
    # A row a persona: as many as the table names, joined by AQE's choice.
    j = df.join(any_effect.select("persona", "empirical_effect"), "persona", "left").crossJoin(F.broadcast(s))
    some = any_effect.limit(1).count() > 0
    degenerate = (F.col("__sd") < 1e-4) | (F.col("__pos") == 0) | (F.col("__pos") == 1)
    blend = F.lit(0.7) * F.coalesce("empirical_effect", F.lit(0.0)) + F.lit(0.3) * F.col(uplift)
    return j.withColumn("calibrated_uplift", F.when(degenerate & F.lit(some), blend).otherwise(F.col(uplift))).drop(
        "__sd", "__pos", "empirical_effect")


def cumulative_uplift(df: DataFrame, score: str = "uplift_score", t: str = "is_treatment") -> DataFrame:
    """Running sum of the score in decreasing score order with % treated so far."""
    d = df.select("customer_id", F.col(score).cast("double").alias("__s"), F.col(t).cast("double").alias("__t"))
    o = global_order(d, [("__s", False), ("customer_id", True)], sums={"cum_uplift": "__s", "__ct": "__t"},
                     rank_col="k")
    return o.select("customer_id", "k", F.col("__s").alias(score), "cum_uplift",
                    (F.col("__ct") / F.col("k") * 100.0).alias("pct_treated"))
