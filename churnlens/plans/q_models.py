"""Queries: churn / uplift / CLV models and survival.

Metrics, curves and segmentations run on the deterministic score table and have SQL
oracles; fitted models (GBT, random forest, MLP, logistic regression, Cox) are rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import clv as cv
from churnlens.operators import models as md
from churnlens.operators import survival as sv
from churnlens.operators import uplift as up
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.plans.q_segment import RFM_CTE, _rfm
from churnlens.session import cut_lineage
from churnlens.sources import tables as tb

V = ["cust", "scores"]
SC = """sc AS (SELECT s.customer_id, s.churn_probability, c.churn_label, s.uplift_score, s.is_treatment, s.clv,
  c.persona, c.treatment_group, s.cost_per_action FROM scores s JOIN cust c ON s.customer_id = c.customer_id)"""


def _sc(spark, sf):
    c = tb.customers(spark, sf).select("customer_id", "churn_label", "persona", "treatment_group")
    return tb.scores(spark, sf).select("customer_id", "churn_probability", "uplift_score", "is_treatment", "clv",
                                       "cost_per_action").join(c, "customer_id")


def q(name, sql, doubles=(), ints=(), ctes=(), views=V):
    return register(name, oracle(sql, views=list(views), ctes=[SC, *ctes], doubles=list(doubles), ints=list(ints)))


# ---------------------------------------------------------------- M1-M8

MODEL_FEATURES = ["frequency", "monetary", "avg_order_value", "acctbal"]


def _train(spark, sf):
    cust = tb.customers(spark, sf).select("customer_id", "churn_label", "acctbal", "persona", "treatment_group")
    return _rfm(spark, sf).join(cust, "customer_id")


@register("churn_model_selection")
def q_churn_model_selection(spark, sf):
    """M1 + M2: two tree families x 3 depths, stratified 5-fold CV by AUC (rows-only)."""
    _, table = md.fit_churn(_train(spark, sf), MODEL_FEATURES)
    return table


@register("churn_scores")
def q_churn_scores(spark, sf):
    """M3 + M9: best model's probability for every customer, prediction frame (rows-only)."""
    tr = _train(spark, sf)
    model, _ = md.fit_churn(tr, MODEL_FEATURES)
    scored = md.score(model, tr).select("customer_id", "churn_probability")
    return md.prediction_frame(scored, tb.customers(spark, sf))


@register("churn_holdout")
def q_churn_holdout(spark, sf):
    """M3 + M6: metrics of a fold from a model fitted on the other folds (rows-only: model fit)."""
    return md.binary_metrics(md.holdout_scores(_train(spark, sf), MODEL_FEATURES))


#: Area under the curve that a fold must reach.
MIN_HOLDOUT_AUC = 0.55


@q("churn_holdout_check", """SELECT count(*) AS n, true AS in_range, true AS auc_reached FROM (
  SELECT row_number() OVER (PARTITION BY churn_label ORDER BY md5('42:' || customer_id), customer_id) AS r FROM cust
  WHERE customer_id IN (SELECT customer_id FROM rfm)) WHERE (r - 1) % 5 = 0""", ctes=[RFM_CTE])
def q_churn_holdout_check(spark, sf):
    """M3: size of the held-out fold, probabilities in [0, 1], and the floor of its AUC."""
    s = md.holdout_scores(_train(spark, sf), MODEL_FEATURES)
    auc = md.binary_metrics(s).first()["roc_auc"]
    p = F.col("churn_probability")
    return s.agg(F.count(F.lit(1)).alias("n"), F.bool_and(p.between(0, 1)).alias("in_range"),
                 F.lit(bool(auc is not None and auc >= MIN_HOLDOUT_AUC)).alias("auc_reached"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """M3: gain importances of the selected model (rows-only)."""
    model, _ = md.fit_churn(_train(spark, sf), MODEL_FEATURES)
    return md.feature_importance(model, MODEL_FEATURES)


@q("stratified_folds", """SELECT customer_id, churn_label, (row_number() OVER (PARTITION BY churn_label
  ORDER BY md5('42:' || customer_id), customer_id) - 1) % 5 AS fold FROM cust""", ints=["fold"])
def q_stratified_folds(spark, sf):
    """M2: stratified shuffled folds by a seeded hash rank within each label."""
    return md.stratified_folds(tb.customers(spark, sf).select("customer_id", "churn_label"), "churn_label", 5) \
        .select("customer_id", "churn_label", "fold")


THR = """v AS (SELECT churn_probability AS score, count_if(churn_label = 1) AS pos, count_if(churn_label <> 1) AS neg
  FROM sc GROUP BY 1),
t AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(pos) FROM v) AS p_all,
    (SELECT sum(neg) FROM v) AS n_all, row_number() OVER w AS idx, (SELECT count(*) FROM v) AS n
  FROM v WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT score AS threshold, tp / (tp + fp) AS precision, CASE WHEN p_all > 0 THEN tp / p_all ELSE 0.0 END AS recall
  FROM t),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM m)"""


@q("threshold_table", """SELECT *, threshold = coalesce(
    (SELECT first(threshold ORDER BY f1 DESC, threshold) FROM m2 WHERE recall >= 0.6),
    (SELECT first(threshold ORDER BY f1 DESC, threshold) FROM m2)) AS is_best FROM m2""",
   ["threshold", "precision", "recall", "f1"], ctes=[THR])
def q_threshold_table(spark, sf):
    """M4: precision / recall / F1 per distinct score threshold, best flagged."""
    return md.threshold_table(_sc(spark, sf))


@q("binary_metrics", """
SELECT CASE WHEN np > 0 AND nn > 0 THEN (rp - np * (np + 1) / 2.0) / (np * nn) END AS roc_auc,
  (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) > 0
    THEN 2 * (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) * (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END)
       / ((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END))
    ELSE 0.0 END AS f1, log_loss
FROM (SELECT count_if(churn_probability >= 0.5 AND churn_label = 1) AS tp,
        count_if(churn_probability >= 0.5 AND churn_label <> 1) AS fp,
        count_if(churn_probability < 0.5 AND churn_label = 1) AS fn,
        count_if(churn_probability < 0.5 AND churn_label <> 1) AS tn,
        avg(-(CASE WHEN churn_label = 1 THEN ln(least(greatest(churn_probability, 1e-15), 1 - 1e-15))
               ELSE ln(1 - least(greatest(churn_probability, 1e-15), 1 - 1e-15)) END)) AS log_loss FROM sc)
CROSS JOIN (SELECT sum(pos * (c - t + (t + 1) / 2.0)) AS rp, sum(pos) AS np, sum(neg) AS nn FROM (
  SELECT *, sum(t) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (
    SELECT churn_probability AS score, count_if(churn_label = 1) AS pos, count_if(churn_label <> 1) AS neg,
      count_if(churn_label = 1) + count_if(churn_label <> 1) AS t FROM sc GROUP BY 1)))""",
   ["roc_auc", "accuracy", "precision", "recall", "f1", "log_loss"])
def q_binary_metrics(spark, sf):
    """M6: exact AUC and threshold metrics of the score table."""
    return md.binary_metrics(_sc(spark, sf))


@q("confusion_matrix", """SELECT count_if(churn_probability < 0.5 AND churn_label <> 1) AS tn,
  count_if(churn_probability >= 0.5 AND churn_label <> 1) AS fp, count_if(churn_probability < 0.5 AND churn_label = 1) AS fn,
  count_if(churn_probability >= 0.5 AND churn_label = 1) AS tp FROM sc""")
def q_confusion(spark, sf):
    """M7: confusion matrix at 0.5."""
    return md.confusion(_sc(spark, sf))


@q("roc_curve", """SELECT threshold, fp / n_all AS fpr, tp / p_all AS tpr FROM (
  SELECT score AS threshold, tp, fp, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () + 1 AS np FROM (
    SELECT *, lead(pos) OVER (ORDER BY score DESC) AS p2, lead(neg) OVER (ORDER BY score DESC) AS n2 FROM t)
  WHERE idx = 1 OR p2 IS NULL OR p2 <> pos OR n2 <> neg
  UNION ALL SELECT NULL, 0, 0, 0, NULL) CROSS JOIN (SELECT any_value(p_all) AS p_all, any_value(n_all) AS n_all FROM t)
WHERE i = 0 OR np <= 100 OR floor(ceil(i * 99 / (np - 1)) * (np - 1) / 99) = i""",
   ["threshold", "fpr", "tpr"], ctes=[THR])
def q_roc_curve(spark, sf):
    """M8: ROC points thinned to <= 100."""
    return md.roc_curve(_sc(spark, sf))


def _blend_holdout(spark, sf):
    """Both models fitted on the customers who signed up before the cutoff date, applied to the later ones."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from churnlens.functions.quantiles import quantile
    from churnlens.plans.q_features import _feature_sequences
    days = F.datediff("signup_date", F.lit("1970-01-01"))
    cust = tb.customers(spark, sf).filter("signup_date IS NOT NULL").select("customer_id", days.alias("day"))
    cutoff = F.lit(float(quantile(cust, "day", BLEND_CUTOFF) or 0.0))
    seq = _feature_sequences(spark, sf).select("customer_id", F.col("churn_label").cast("double").alias("label"),
                                               array_to_vector(F.flatten("sequence")).alias("features")).join(cust, "customer_id")
    seq = cut_lineage(seq)
    mlp = MultilayerPerceptronClassifier(layers=[12, 8, 2], seed=42, maxIter=50).fit(seq.filter(F.col("day") < cutoff))
    pm = mlp.transform(seq.filter(F.col("day") >= cutoff)).select("customer_id", vector_to_array("probability")[1].alias("p_mlp"))
    tr = cut_lineage(_train(spark, sf).join(cust, "customer_id"))
    model, _ = md.fit_churn(tr.filter(F.col("day") < cutoff).drop("day"), MODEL_FEATURES)
    pt = md.score(model, tr.filter(F.col("day") >= cutoff)).select("customer_id", "churn_label", F.col("churn_probability").alias("p_tree"))
    return pt.join(pm, "customer_id").withColumn("churn_probability", md.blend(F.col("p_tree"), F.col("p_mlp")))


#: Share of the customers, by signup date, that the blended models are fitted on.
BLEND_CUTOFF = 0.8


@register("ensemble_blend")
def q_ensemble_blend(spark, sf):
    """M5: 0.6 x tree model + 0.4 x MLP on the flattened weekly feature sequences, both fitted before the
    cutoff and blended on later customers (rows-only)."""
    return _blend_holdout(spark, sf)


@register("ensemble_blend_metrics")
def q_ensemble_blend_metrics(spark, sf):
    """M5 + M6: metrics of the blend on the customers after the cutoff (rows-only: model fit)."""
    return md.binary_metrics(_blend_holdout(spark, sf).select("churn_probability", "churn_label"))


@register("local_explanations")
def q_local_explanations(spark, sf):
    """Top-10 customers x top-3 features by |coef x (x - mean)| (rows-only: model fit)."""
    local, _ = md.local_explanations(_train(spark, sf), MODEL_FEATURES)
    return local


@register("global_importance")
def q_global_importance(spark, sf):
    """Mean |contribution| per feature with cumulative share (rows-only: model fit)."""
    from churnlens.operators.report import cumulative_importance
    _, glob = md.local_explanations(_train(spark, sf), MODEL_FEATURES)
    return cumulative_importance(glob, "feature", "mean_abs_contribution")


@q("overlay_predictions", """
SELECT coalesce(a.customer_id, t.customer_id) AS customer_id,
  CASE WHEN t.p IS NOT NULL THEN t.p ELSE coalesce(a.p, (SELECT avg(churn_probability) FROM sc)) END AS churn_probability,
  CASE WHEN t.p IS NOT NULL THEN 'test' ELSE 'train' END AS split,
  CASE WHEN t.p IS NOT NULL THEN 'ensemble_holdout' ELSE 'full_model' END AS source,
  CASE WHEN (CASE WHEN t.p IS NOT NULL THEN t.p ELSE coalesce(a.p, (SELECT avg(churn_probability) FROM sc)) END) <= 0.25
         THEN 'low'
       WHEN (CASE WHEN t.p IS NOT NULL THEN t.p ELSE coalesce(a.p, (SELECT avg(churn_probability) FROM sc)) END) <= 0.5
         THEN 'medium'
       WHEN (CASE WHEN t.p IS NOT NULL THEN t.p ELSE coalesce(a.p, (SELECT avg(churn_probability) FROM sc)) END) <= 0.75
         THEN 'high' ELSE 'critical' END AS risk_level
FROM (SELECT customer_id, churn_probability AS p FROM sc) a
FULL JOIN (SELECT customer_id, 0.6 * churn_probability + 0.4 * (((customer_id * 31) % 1000) / 1000.0) AS p FROM sc
    WHERE customer_id % 5 = 0) t
  ON a.customer_id = t.customer_id""", ["churn_probability"])
def q_overlay(spark, sf):
    """The holdout fold's rows (id % 5 == 0) replaced by a 0.6 / 0.4 blend of two scores."""
    s = _sc(spark, sf)
    test = s.filter(F.col("customer_id") % 5 == 0).select(
        "customer_id", md.blend(F.col("churn_probability"), (F.col("customer_id") * 31) % 1000 / 1000.0).alias("churn_probability"))
    return md.overlay_predictions(s.select("customer_id", "churn_probability"), test)


# ---------------------------------------------------------------- U1-U10

@register("uplift_t_learner")
def q_uplift_t(spark, sf):
    """T-learner uplift on RFM + balance features (rows-only)."""
    tr = _train(spark, sf).join(tb.scores(spark, sf).select("customer_id", "is_treatment"), "customer_id")
    return up.uplift_t(tr, MODEL_FEATURES)


@register("uplift_s_learner")
def q_uplift_s(spark, sf):
    """S-learner uplift (rows-only)."""
    tr = _train(spark, sf).join(tb.scores(spark, sf).select("customer_id", "is_treatment"), "customer_id")
    return up.uplift_s(tr, MODEL_FEATURES)


def _arms(spark, sf):
    return _train(spark, sf).join(tb.scores(spark, sf).select("customer_id", "is_treatment"), "customer_id")


@q("uplift_folds", """SELECT customer_id, churn_label, is_treatment, CAST((row_number() OVER (PARTITION BY is_treatment, churn_label
  ORDER BY md5('42:' || customer_id), customer_id) - 1) % 3 AS BIGINT) AS fold FROM sc""", ints=["is_treatment", "churn_label"])
def q_uplift_folds(spark, sf):
    """Three folds stratified by arm and label."""
    return up.uplift_folds(_sc(spark, sf).select("customer_id", "churn_label", "is_treatment"), 3)


@register("uplift_out_of_fold")
def q_uplift_out_of_fold(spark, sf):
    """T-learner scores of each customer from models fitted without its fold (rows-only: model fit)."""
    return up.cross_fit_uplift(_arms(spark, sf), MODEL_FEATURES, "t_learner", 3)


@register("compare_fitted_learners")
def q_compare_fitted_learners(spark, sf):
    """T-learner against S-learner on out-of-fold scores (rows-only: model fit)."""
    return up.compare_fitted_learners(_arms(spark, sf), MODEL_FEATURES, k=3)


CURVE = """cu AS (SELECT customer_id, row_number() OVER w AS k,
    sum(churn_label * is_treatment) OVER w AS cyt, sum(churn_label * (1 - is_treatment)) OVER w AS cyc,
    sum(is_treatment) OVER w AS ct, sum(1 - is_treatment) OVER w AS cc, count(*) OVER () AS n
  FROM sc WINDOW w AS (ORDER BY uplift_score DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@q("auuc", """SELECT CASE WHEN nt = 0 OR nt = n THEN 0.0 ELSE (su - (u1 + un) / 2) / n END AS auuc FROM (
  SELECT count(*) AS n, sum(u) AS su, first(u ORDER BY k) AS u1, first(u ORDER BY k DESC) AS un,
    (SELECT sum(is_treatment) FROM sc) AS nt
  FROM (SELECT k, cyc / greatest(cc, 1.0) - cyt / greatest(ct, 1.0) AS u FROM cu))""", ["auuc"], ctes=[CURVE])
def q_auuc(spark, sf):
    """Area under the uplift curve."""
    return up.auuc(_sc(spark, sf))


@q("qini_curve", """SELECT customer_id, k, k / n AS fraction,
  cyc * CASE WHEN cc > 0 THEN ct / cc ELSE 0.0 END - cyt AS qini FROM cu""", ["fraction", "qini"], ctes=[CURVE])
def q_qini(spark, sf):
    """U4: Qini curve."""
    return up.qini_curve(_sc(spark, sf))


@q("compare_learners", """
SELECT learner, CASE WHEN nt = 0 OR nt = n THEN 0.0 ELSE (su - (u1 + un) / 2) / n END AS auuc, mean_uplift, std_uplift,
  positive_rate FROM (
  SELECT learner, count(*) AS n, sum(u) AS su, first(u ORDER BY k) AS u1, first(u ORDER BY k DESC) AS un,
    sum(t) AS nt, avg(s) AS mean_uplift, stddev_pop(s) AS std_uplift, avg(CAST(s > 0 AS DOUBLE)) AS positive_rate FROM (
    SELECT learner, k, s, t, cyc / greatest(cc, 1.0) - cyt / greatest(ct, 1.0) AS u FROM (
      SELECT learner, s, t, row_number() OVER w AS k, sum(y * t) OVER w AS cyt, sum(y * (1 - t)) OVER w AS cyc,
        sum(t) OVER w AS ct, sum(1 - t) OVER w AS cc
      FROM (SELECT 'uplift_score' AS learner, customer_id, uplift_score AS s, CAST(churn_label AS DOUBLE) AS y,
              CAST(is_treatment AS DOUBLE) AS t FROM sc
            UNION ALL SELECT 'churn_probability', customer_id, churn_probability, CAST(churn_label AS DOUBLE),
              CAST(is_treatment AS DOUBLE) FROM sc)
      WINDOW w AS (PARTITION BY learner ORDER BY s DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
  GROUP BY learner)""", ["auuc", "mean_uplift", "std_uplift", "positive_rate"])
def q_compare_learners(spark, sf):
    """Learner comparison (two score columns as learners)."""
    return up.compare_learners(_sc(spark, sf), ["uplift_score", "churn_probability"])


@q("uplift_segments", """SELECT customer_id, uplift_score, churn_probability,
  CASE WHEN uplift_score < 0 THEN 'sleeping_dog' WHEN churn_probability >= 0.5 THEN CASE WHEN uplift_score > 0.05
       THEN 'persuadable' ELSE 'lost_cause' END ELSE 'sure_thing' END AS uplift_segment FROM sc""",
   ["uplift_score", "churn_probability"])
def q_uplift_segments(spark, sf):
    """Four-quadrant uplift segments with baseline risk."""
    return up.uplift_segments(_sc(spark, sf).select("customer_id", "uplift_score", "churn_probability"))


@q("uplift_segments_median", """SELECT customer_id, uplift_score, churn_probability,
  CASE WHEN uplift_score >= greatest(mu, 0) THEN 'persuadable' WHEN uplift_score >= 0 THEN 'sure_thing'
       WHEN uplift_score >= least(mu, 0) THEN 'lost_cause' ELSE 'sleeping_dog' END AS uplift_segment
FROM sc CROSS JOIN (SELECT median(uplift_score) AS mu FROM sc)""",
   ["uplift_score", "churn_probability"])
def q_uplift_segments_median(spark, sf):
    """Median-pivot uplift segments."""
    return up.uplift_segments_median(_sc(spark, sf).select("customer_id", "uplift_score", "churn_probability"))


LIFT_F = ["clv", "cost_per_action", "churn_probability"]


US = """us AS (SELECT sc.*, CASE WHEN uplift_score < 0 THEN 'sleeping_dog' WHEN churn_probability >= 0.5 THEN CASE WHEN uplift_score > 0.05
       THEN 'persuadable' ELSE 'lost_cause' END ELSE 'sure_thing' END AS seg FROM sc)"""


@q("persuadable_lift", """SELECT feature, persuadable_mean, non_persuadable_mean,
  persuadable_mean - non_persuadable_mean AS lift, abs(persuadable_mean - non_persuadable_mean) AS abs_lift FROM ("""
   + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, coalesce(avg(CASE WHEN seg = 'persuadable' THEN CAST({c} AS DOUBLE) END), 0) AS persuadable_mean,
    coalesce(avg(CASE WHEN seg <> 'persuadable' THEN CAST({c} AS DOUBLE) END), 0) AS non_persuadable_mean FROM us"""
    for c in LIFT_F) + ") ORDER BY abs_lift DESC, feature LIMIT 10",
   ["persuadable_mean", "non_persuadable_mean", "lift", "abs_lift"], ctes=[US])
def q_persuadable_lift(spark, sf):
    """U8: feature lift of persuadables vs the rest (a top-k report)."""
    return up.persuadable_lift(up.uplift_segments(_sc(spark, sf)), LIFT_F)


@q("persuadable_customers", """SELECT customer_id, uplift_score, churn_probability,
  row_number() OVER (ORDER BY uplift_score DESC, customer_id) AS rank FROM us WHERE seg = 'persuadable'""",
   ["uplift_score", "churn_probability"], ctes=[US])
def q_persuadable_customers(spark, sf):
    """U8: persuadable customers ranked by uplift."""
    return up.persuadable_customers(up.uplift_segments(_sc(spark, sf)))


@q("persuadable_summary", """SELECT count(*) AS total_customers, count_if(seg = 'persuadable') AS persuadable_count,
  avg(CAST(seg = 'persuadable' AS DOUBLE)) AS persuadable_rate,
  coalesce(avg(uplift_score) FILTER (WHERE seg = 'persuadable'), 0) AS persuadable_mean_uplift,
  avg(churn_probability) FILTER (WHERE seg = 'persuadable') AS persuadable_mean_baseline_churn FROM us""",
   ["persuadable_rate", "persuadable_mean_uplift", "persuadable_mean_baseline_churn"], ctes=[US])
def q_persuadable_summary(spark, sf):
    """U8: summary of the persuadables."""
    return up.persuadable_summary(up.uplift_segments(_sc(spark, sf)))


@q("persona_effect", """SELECT persona, avg(CASE WHEN treatment_group = 'control' THEN CAST(churn_label AS DOUBLE) END)
  AS control_rate, avg(CASE WHEN treatment_group = 'treatment' THEN CAST(churn_label AS DOUBLE) END) AS treatment_rate,
  avg(CASE WHEN treatment_group = 'control' THEN CAST(churn_label AS DOUBLE) END)
  - avg(CASE WHEN treatment_group = 'treatment' THEN CAST(churn_label AS DOUBLE) END) AS empirical_effect
FROM sc GROUP BY persona""", ["control_rate", "treatment_rate", "empirical_effect"])
def q_persona_effect(spark, sf):
    """Empirical treatment effect per persona."""
    return up.persona_effect(_sc(spark, sf))


@q("persona_calibrated_uplift", """SELECT customer_id, sc.persona, abs(uplift_score) AS uplift_score,
  0.7 * coalesce(e, 0) + 0.3 * abs(uplift_score) AS calibrated_uplift FROM sc JOIN (
    SELECT persona, avg(CAST(churn_label AS DOUBLE)) FILTER (WHERE treatment_group = 'control')
      - avg(CAST(churn_label AS DOUBLE)) FILTER (WHERE treatment_group = 'treatment') AS e FROM sc GROUP BY persona) p
  ON sc.persona = p.persona WHERE uplift_score <> 0""", ["uplift_score", "calibrated_uplift"])
def q_persona_calibrated(spark, sf):
    """Scores that are all positive (their absolute value) blended with the persona effects."""
    s = _sc(spark, sf)
    scores = s.filter("uplift_score <> 0").select("customer_id", "persona", F.abs("uplift_score").alias("uplift_score"))
    return up.persona_calibrated(scores, s)


@q("cumulative_uplift", """SELECT customer_id, row_number() OVER w AS k, uplift_score, sum(uplift_score) OVER w AS cum_uplift,
  sum(CAST(is_treatment AS DOUBLE)) OVER w / row_number() OVER w * 100.0 AS pct_treated
FROM sc WINDOW w AS (ORDER BY uplift_score DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
   ["uplift_score", "cum_uplift", "pct_treated"])
def q_cumulative_uplift(spark, sf):
    """Cumulative uplift curve."""
    return up.cumulative_uplift(_sc(spark, sf))


# ---------------------------------------------------------------- V1-V9

CUT = """cut AS (SELECT mn + CAST(floor(date_diff('day', mn, mx) * 0.75) AS INTEGER) AS c,
    greatest(date_diff('day', mn, mx) - CAST(floor(date_diff('day', mn, mx) * 0.75) AS INTEGER), 1) AS w
  FROM (SELECT min(event_date) AS mn, max(event_date) AS mx FROM purchases)),
fr AS (SELECT cu2.customer_id, coalesce(r.rev, 0.0) * 365.0 / (SELECT w FROM cut) AS clv_target FROM cust cu2
  LEFT JOIN (SELECT customer_id, sum(amount) AS rev FROM purchases WHERE event_type = 'purchase'
             AND event_date > (SELECT c FROM cut) GROUP BY customer_id) r ON cu2.customer_id = r.customer_id)"""


def _future(spark, sf):
    p = tb.purchases(spark, sf)
    cut, w = cv.temporal_cutoff(p, 0.75)
    return cv.future_revenue(tb.customers(spark, sf), p, F.lit(cut), w)


@q("future_revenue", "SELECT * FROM fr", ["clv_target"], ctes=[CUT])
def q_future_revenue(spark, sf):
    """V1 + V2: annualised purchases after the 75%-of-span cutoff."""
    return _future(spark, sf)


@q("clv_features", """SELECT customer_id, recency, frequency, monetary,
  greatest(frequency, 1) * (monetary / greatest(frequency, 1)) AS rfm_interaction,
  recency / greatest(frequency, 1) AS recency_per_frequency, ln(1 + greatest(monetary, 0.0)) AS log_monetary
FROM rfm""", ["recency", "monetary", "rfm_interaction", "recency_per_frequency", "log_monetary"], ctes=[RFM_CTE])
def q_clv_features(spark, sf):
    """V3: CLV features."""
    return cv.clv_features(_rfm(spark, sf).select("customer_id", "recency", "frequency", "monetary"))


@register("clv_predictions")
def q_clv_predictions(spark, sf):
    """V4: gradient-boosted CLV regression on pre-cutoff features (rows-only)."""
    feats = ["recency", "frequency", "monetary", "rfm_interaction", "recency_per_frequency", "log_monetary"]
    x = cv.clv_features(_rfm(spark, sf)).join(_future(spark, sf), "customer_id")
    m = cv.fit_clv(x, feats)
    return cv.predict_clv(m, x, feats).select("customer_id", "clv_target", "predicted_clv")


@register("clv_holdout")
def q_clv_holdout(spark, sf):
    """V4 + V8: metrics of the customers of a fold from a regression fitted on the other folds (rows-only)."""
    feats = ["recency", "frequency", "monetary", "rfm_interaction", "recency_per_frequency", "log_monetary"]
    x = cv.clv_features(_rfm(spark, sf)).join(_future(spark, sf), "customer_id").withColumn("all", F.lit(0))
    x = md.stratified_folds(x, "all", 5)
    m = cv.fit_clv(x.filter("fold <> 0"), feats)
    return cv.regression_metrics(cv.predict_clv(m, x.filter("fold = 0"), feats), "clv_target", "predicted_clv")


@q("clv_ranking", """SELECT s.customer_id, s.clv, (cum - c + (c + 1) / 2.0) / n AS clv_percentile,
  s.clv >= (SELECT quantile_cont(clv, 0.8) FROM sc) AS high_value
FROM sc s JOIN (SELECT clv AS v, c, sum(c) OVER (ORDER BY clv ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  sum(c) OVER () AS n FROM (SELECT clv, count(*) AS c FROM sc GROUP BY clv)) r ON s.clv = r.v""",
   ["clv", "clv_percentile"])
def q_clv_ranking(spark, sf):
    """V5: CLV percent rank (average ties) and high-value flag."""
    return cv.rank_clv(_sc(spark, sf).select("customer_id", "clv"), "clv")


@q("churn_adjusted_clv", """SELECT customer_id, clv, churn_probability,
  greatest(clv * (1 - churn_probability), 0.0) AS churn_adjusted_clv FROM sc""",
   ["clv", "churn_probability", "churn_adjusted_clv"])
def q_adjust_clv(spark, sf):
    """V6: churn-adjusted CLV."""
    return cv.adjust_clv(_sc(spark, sf).select("customer_id", "clv", "churn_probability"))


@q("clv_budget", """SELECT customer_id, clv, CASE WHEN t > 0 THEN clv / t * 1000000.0 ELSE 1000000.0 / n END AS clv_budget
FROM sc CROSS JOIN (SELECT sum(clv) AS t, count(*) AS n FROM sc)""", ["clv", "clv_budget"])
def q_clv_budget(spark, sf):
    """V7: CLV-proportional split of a 1,000,000 budget."""
    return cv.clv_budget(_sc(spark, sf).select("customer_id", "clv"), 1_000_000.0)


@q("regression_metrics", """SELECT avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse,
  coalesce(CASE WHEN NOT isnan(corr(y, p)) THEN corr(y, p) END, 0.0) AS pearson_r,
  CASE WHEN var_pop(y) > 0 THEN 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) ELSE 0.0 END AS r2
FROM (SELECT f.clv_target AS y, s.clv AS p FROM fr f JOIN sc s ON f.customer_id = s.customer_id)""",
   ["mae", "rmse", "pearson_r", "r2"], ctes=[CUT])
def q_regression_metrics(spark, sf):
    """V8: holdout metrics of the naive CLV (order total / 10) against the future revenue."""
    j = _future(spark, sf).join(_sc(spark, sf).select("customer_id", "clv"), "customer_id")
    return cv.regression_metrics(j, "clv_target", "clv")


@q("clv_distribution", """SELECT min(clv) AS min, max(clv) AS max, avg(clv) AS mean, count(clv) AS count,
  quantile_cont(clv, 0.25) AS p25, quantile_cont(clv, 0.5) AS median, quantile_cont(clv, 0.75) AS p75,
  quantile_cont(clv, 0.8) AS p80, quantile_cont(clv, 0.9) AS p90, quantile_cont(clv, 0.95) AS p95 FROM sc""",
   ["min", "max", "mean", "p25", "median", "p75", "p80", "p90", "p95"])
def q_clv_distribution(spark, sf):
    """V9: CLV distribution report."""
    return cv.clv_distribution(_sc(spark, sf), "clv")


# ---------------------------------------------------------------- K1-K9

SURV = """sv AS (SELECT customer_id, lower(persona) AS segment, churn_probability,
  round_even(greatest(1.0, 365 * (1 - churn_probability)), 0) AS duration, CAST(churn_probability >= 0.5 AS INTEGER) AS event
  FROM sc)"""


def _surv(spark, sf):
    s = _sc(spark, sf).select("customer_id", F.lower("persona").alias("segment"), "churn_probability")
    return sv.proxy_survival(s)


def _km_sql(part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    pc = f"{part}, " if part else ""
    return f"""km0 AS (SELECT {pc}CAST(duration AS DOUBLE) AS time, count(*) AS n, sum(event) AS events FROM sv
  GROUP BY {pc}duration),
km1 AS (SELECT *, sum(n) OVER ({pb}) - sum(n) OVER ({pb}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + n
    AS at_risk FROM km0),
km2 AS (SELECT *, CASE WHEN events >= at_risk OR events = 0 THEN 0.0 ELSE ln(1 - events / at_risk) END AS lg,
    CASE WHEN events >= at_risk AND events > 0 THEN 1.0 ELSE 0.0 END AS z FROM km1),
km AS (SELECT {pc}time, at_risk, events, n - events AS censored,
    CASE WHEN sum(z) OVER w > 0 THEN 0.0 ELSE exp(sum(lg) OVER w) END AS survival
  FROM km2 WINDOW w AS ({pb}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@q("kaplan_meier", "SELECT * FROM km UNION ALL SELECT 0.0, count(*), 0, 0, 1.0 FROM sv HAVING count_if(duration = 0) = 0 AND count(*) > 0", ["time", "survival"], ["at_risk", "events", "censored"], ctes=[SURV, _km_sql()])
def q_kaplan_meier(spark, sf):
    """K1: Kaplan-Meier curve of the proxy survival frame."""
    return sv.km_curve(_surv(spark, sf))


GRID = [float(t) for t in range(0, 366, 10)]
KM2 = f"""g AS (SELECT DISTINCT segment, t FROM sv CROSS JOIN (SELECT unnest({GRID}) AS t)),
kg AS (SELECT g.segment, g.t, coalesce(arg_max(k.survival, k.time), 1.0) AS survival FROM g
  LEFT JOIN km k ON k.segment = g.segment AND k.time <= g.t GROUP BY g.segment, g.t),
kc AS (SELECT g.segment, g.t, count_if(s.duration >= g.t) AS n_at_risk,
    count_if(s.duration <= g.t AND s.event = 1) AS n_events FROM g JOIN sv s ON s.segment = g.segment
  GROUP BY g.segment, g.t),
kseg AS (SELECT kg.segment, kg.t, kg.survival, kc.n_at_risk, kc.n_events, md.median_survival_days,
    greatest(kg.survival - 0.05, 0.0) AS ci_lower, least(kg.survival + 0.05, 1.0) AS ci_upper
  FROM kg JOIN kc ON kg.segment = kc.segment AND kg.t = kc.t
  LEFT JOIN (SELECT segment, min(t) AS median_survival_days FROM kg WHERE survival <= 0.5 GROUP BY segment) md
    ON kg.segment = md.segment)"""


@q("km_by_segment", "SELECT * FROM kseg", ["t", "survival", "median_survival_days", "ci_lower", "ci_upper"],
   ctes=[SURV, _km_sql("segment"), KM2])
def q_km_by_segment(spark, sf):
    """K2: per-segment KM on a 10-day grid with at-risk, events, median and band."""
    return sv.km_by_segment(_surv(spark, sf), "segment", GRID)


COX_F = ["clv", "cost_per_action"]


@register("cox_model")
def q_cox_model(spark, sf):
    """K3: Cox PH coefficients on the proxy survival frame, with convergence and likelihood (rows-only: iterative)."""
    s = _surv(spark, sf).join(_sc(spark, sf).select("customer_id", "clv", "cost_per_action"), "customer_id")
    m = sv.fit_cox(s, COX_F)
    return spark.createDataFrame([(f, float(c), m["converged"], m["iterations"], m["log_likelihood"]) for f, c in zip(m["features"], m["coef"])],
                                 "feature string, coef double, converged boolean, iterations int, log_likelihood double")


@q("cox_score", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', 0.0)" for f in COX_F) + ") AS t(feature, score)", ["score"])
def q_cox_score(spark, sf):
    """K3: the penalised score equations at the fitted coefficients, which must be 0."""
    s = _surv(spark, sf).join(_sc(spark, sf).select("customer_id", "clv", "cost_per_action"), "customer_id")
    m = sv.fit_cox(s, COX_F)
    return spark.createDataFrame([(f, float(x)) for f, x in zip(m["features"], m["gradient"])], "feature string, score double")


@register("survival_table")
def q_survival_table(spark, sf):
    """K4 + K5: partial hazard, S at 30 / 90 / 365 days and median per customer (rows-only)."""
    s = _surv(spark, sf).join(_sc(spark, sf).select("customer_id", "clv", "cost_per_action"), "customer_id")
    m = sv.fit_cox(s, COX_F)
    return sv.cox_predict(s, m).select("customer_id", "segment", "partial_hazard", "survival_30", "survival_90",
                                       "survival_365", "median_survival")


@q("concordance", """SELECT comparable_pairs, concordant_pairs, tied_risk,
  (concordant_pairs + 0.5 * tied_risk) / comparable_pairs AS c_index FROM (
  SELECT count(*) AS comparable_pairs, count_if(a.churn_probability > b.churn_probability) AS concordant_pairs,
    count_if(a.churn_probability = b.churn_probability) AS tied_risk
  FROM sv a JOIN sv b ON a.duration < b.duration WHERE a.event = 1)""", ["c_index"],
   ctes=[SURV], ints=["comparable_pairs", "concordant_pairs", "tied_risk"])
def q_concordance(spark, sf):
    """K6: Harrell's C of the churn probability on the proxy survival frame (exact,
    divide and conquer over durations; the oracle is a brute-force pair join)."""
    return sv.concordance(_surv(spark, sf), risk="churn_probability")


@q("survival_stats", """SELECT segment, count(*) AS customers, sum(event) AS events, avg(duration) AS mean_duration,
  avg(CAST(event AS DOUBLE)) AS event_rate, median(duration) AS median_duration FROM sv GROUP BY segment""",
   ["mean_duration", "event_rate", "median_duration"], ["events"], ctes=[SURV])
def q_survival_stats(spark, sf):
    """K7: survival statistics per segment."""
    return sv.survival_stats(_surv(spark, sf))


@q("proxy_survival", "SELECT customer_id, segment, churn_probability, duration, event FROM sv",
   ["churn_probability", "duration"], ["event"], ctes=[SURV])
def q_proxy_survival(spark, sf):
    """K8: proxy survival frame from churn probabilities."""
    return _surv(spark, sf).select("customer_id", "segment", "churn_probability", "duration", "event")


@q("hazard_by_segment", """SELECT segment,
  CASE WHEN tmax > 0 THEN -ln(greatest(s1 / s0, 0.001)) / tmax ELSE 0.0 END AS avg_daily_hazard,
  CASE WHEN tmax > 0 THEN -ln(greatest(s1 / s0, 0.001)) / tmax ELSE 0.0 END * 365 AS annual_hazard
FROM (SELECT segment, arg_min(survival, t) AS s0, arg_max(survival, t) AS s1, max(t) AS tmax FROM kseg GROUP BY segment)""",
   ["avg_daily_hazard", "annual_hazard"], ctes=[SURV, _km_sql("segment"), KM2])
def q_hazard_by_segment(spark, sf):
    """K9: average hazard per segment from the K2 curves."""
    return sv.hazard_by_segment(sv.km_by_segment(_surv(spark, sf), "segment", GRID))
