"""Churn classifier, metrics and explanations.

Training is Spark ML (``GBTClassifier`` / ``RandomForestClassifier`` in a ``Pipeline``,
``CrossValidator`` with a stratified ``foldCol``). Every metric over (score, label)
pairs aggregates by distinct score first (V-agg) and uses distributed prefix sums, so
ROC / PR / AUC never sort raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import risk_level_right_closed
from churnlens.functions.prefix import global_order
from churnlens.session import cut_lineage


# ------------------------------------------------------------------ M1-M3

def stratified_folds(df: DataFrame, label: str | list[str], k: int = 5, seed: int = 42, id_col: str = "customer_id") -> DataFrame:
    """M2: rank within each label (or combination of labels) by a seeded hash, fold = rank mod k."""
    strata = [label] if isinstance(label, str) else list(label)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    r = global_order(df.withColumn("__h", h), [("__h", True), (id_col, True)], partition_by=strata, rank_col="__r")
    return r.withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r")


def fit_churn(train: DataFrame, features: list[str], label: str = "churn_label", k: int = 5, seed: int = 42,
              id_col: str = "customer_id"):
    """M1: GBT and random forest, 3 settings each, stratified k-fold CV on AUC, refit best.

    Positive class weight neg/pos when the positive rate is below 0.30. Returns
    ``(best_model, table of (family, setting, mean_auc))``.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    st = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.0
    wpos = (1 - st) / st if 0 < st < 0.30 else 1.0
    data = stratified_folds(train.withColumn("__w", F.when(F.col(label) == 1, wpos).otherwise(1.0))
                            .withColumn("label", F.col(label).cast("double")), "label", k, seed, id_col)
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    # every fold of every candidate re-reads the training frame: assemble it and cut the lineage once
    data = cut_lineage(va.transform(data.select("label", "__w", "fold", *features)).drop(*features))
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    fams = [("gbt", GBTClassifier(labelCol="label", weightCol="__w", seed=seed, maxIter=20), [2, 3, 4]),
            ("random_forest", RandomForestClassifier(labelCol="label", weightCol="__w", seed=seed, numTrees=30), [3, 5, 7])]
    # One grid over both families: a fold is cached once, its settings are fitted side by side, only the best is refitted.
    pipe, grid, names = Pipeline(stages=[]), [], []
    for name, est, depths in fams:
        grid += ParamGridBuilder().baseOn({pipe.stages: [est]}).addGrid(est.maxDepth, depths).build()
        names += [(name, str({est.maxDepth.name: d})) for d in depths]
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=k, seed=seed,
                        parallelism=len(grid))
    m = cv.fit(data)
    table = train.sparkSession.createDataFrame([(*n, float(auc)) for n, auc in zip(names, m.avgMetrics)],
                                               "family string, setting string, mean_auc double")
    return PipelineModel([va, *m.bestModel.stages]), table


def score(model, df: DataFrame, out_col: str = "churn_probability") -> DataFrame:
    """M3: probability of the positive class."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(out_col, vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model, features: list[str]) -> DataFrame:
    """M3: tree-model gain importances as a table (one row per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")


def holdout_scores(df: DataFrame, features: list[str], label: str = "churn_label", k: int = 5, seed: int = 42,
                   id_col: str = "customer_id") -> DataFrame:
    """M3: probabilities of one fold from a model fitted on the other folds only:
    (id, label, churn_probability)."""
    from churnlens.operators.uplift import _gbt
    from pyspark.ml.functions import vector_to_array
    # the fit reads the folds several times
    d = cut_lineage(stratified_folds(df.select(id_col, label, *features).na.fill(0.0, features), label, k, seed, id_col)
                    .withColumn("label", F.col(label).cast("double")))
    model = _gbt(features, seed).fit(d.filter("fold <> 0"))
    return model.transform(d.filter("fold = 0")).select(
        id_col, label, vector_to_array("probability")[1].alias("churn_probability"))


# ------------------------------------------------------------------ M4, M6-M8

def score_table(scored: DataFrame, score_col: str, label: str) -> DataFrame:
    """V-agg: per distinct score (descending) the positives and negatives, with prefix sums
    ``tp`` / ``fp`` = counts with score >= this score."""
    v = scored.groupBy(F.col(score_col).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return global_order(v, [("score", False)], sums={"tp": "pos", "fp": "neg"}, rank_col="idx")


def threshold_table(scored: DataFrame, score_col: str = "churn_probability", label: str = "churn_label",
                    min_recall: float = 0.60) -> DataFrame:
    """M4: precision / recall / F1 at every distinct score; best F1 with recall >= 0.60
    (else best F1) flagged."""
    t = score_table(scored, score_col, label)
    tot = t.agg(F.sum("pos").alias("__P"))
    t = t.crossJoin(F.broadcast(tot))
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(F.col("__P") > 0, F.col("tp") / F.col("__P")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    t = t.select(F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
    ok = t.filter(F.col("recall") >= min_recall)
    # Of equal F1 the lowest threshold, which comes first in ascending order.
    best = F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))
    best_ok = ok.agg(best.alias("__b1"))
    best_any = t.agg(best.alias("__b2"))
    return t.crossJoin(best_ok).crossJoin(best_any).withColumn(
        "is_best", F.col("threshold") == F.coalesce("__b1", "__b2")).drop("__b1", "__b2")


def binary_metrics(scored: DataFrame, score_col: str = "churn_probability", label: str = "churn_label",
                   threshold: float = 0.5) -> DataFrame:
    """M6: exact ROC-AUC (mid-ranks of distinct scores), accuracy, precision, recall, F1
    (0 on zero division) and log-loss (probabilities clipped to [1e-15, 1 - 1e-15]); without rows
    AUC, accuracy and log-loss are null."""
    y = F.col(label) == 1
    s = F.col(score_col).cast("double")
    pred = s >= threshold
    eps = 1e-15
    pc = F.least(F.greatest(s, F.lit(eps)), F.lit(1 - eps))
    c = scored.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                   F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"),
                   F.avg(-(F.when(y, F.log(pc)).otherwise(F.log(1 - pc)))).alias("log_loss"))
    v = scored.groupBy(s.alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    o = global_order(v.withColumn("t", F.col("pos") + F.col("neg")), [("score", True)], sums={"__c": "t"},
                     rank_col=None)
    mid = F.col("__c") - F.col("t") + (F.col("t") + 1) / 2.0
    r = o.agg(F.sum(F.col("pos") * mid).alias("__rp"), F.sum("pos").alias("__np"), F.sum("neg").alias("__nn"))
    auc = (F.col("__rp") - F.col("__np") * (F.col("__np") + 1) / 2.0) / (F.col("__np") * F.col("__nn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return c.crossJoin(r).select(
        F.when((F.col("__np") > 0) & (F.col("__nn") > 0), auc).alias("roc_auc"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"), "log_loss")


def confusion(scored: DataFrame, score_col: str = "churn_probability", label: str = "churn_label",
              threshold: float = 0.5) -> DataFrame:
    """M7: tn, fp, fn, tp at a threshold."""
    y = F.col(label) == 1
    p = F.col(score_col) >= threshold
    return scored.agg(F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
                      F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp"))


def roc_curve(scored: DataFrame, score_col: str = "churn_probability", label: str = "churn_label",
              max_points: int = 100) -> DataFrame:
    """M8: (0, 0) and the (fpr, tpr) of the distinct scores, without inner points whose step
    equals the next one, thinned to at most ``max_points`` evenly spaced points (indices
    floor(i (n - 1) / (max_points - 1))). The origin has no threshold."""
    t = score_table(scored, score_col, label)
    after = t.select((F.col("idx") - 1).alias("idx"), F.col("pos").alias("__p"), F.col("neg").alias("__q"))
    t = t.join(after, "idx", "left")
    corner = (F.col("idx") == 1) | F.col("__p").isNull() | (F.col("pos") != F.col("__p")) | (F.col("neg") != F.col("__q"))
    t = global_order(t.filter(corner).select("score", "pos", "neg", "tp", "fp"), [("score", False)], rank_col="__i")
    tot = t.agg(F.max("tp").alias("__P"), F.max("fp").alias("__N"), (F.count(F.lit(1)) + 1).alias("__npts"))
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0, 0)], "score double, tp double, fp double, __i long")
    j = t.select("score", "tp", "fp", "__i").unionByName(origin).crossJoin(F.broadcast(tot))
    n, m = F.col("__npts"), max_points
    # index i0 stays if some i in [0, m) has floor(i (n - 1) / (m - 1)) == i0
    lo = F.ceil(F.col("__i") * (m - 1) / F.greatest(n - 1, F.lit(1)))
    keep = (n > 1) & ((n <= m) | (F.floor(lo * (n - 1) / (m - 1)) == F.col("__i")))
    return j.filter(keep).select(F.col("score").alias("threshold"),
                                 F.when(F.col("__N") > 0, F.col("fp") / F.col("__N")).otherwise(0.0).alias("fpr"),
                                 F.when(F.col("__P") > 0, F.col("tp") / F.col("__P")).otherwise(0.0).alias("tpr"))


# ------------------------------------------------------------------ M5, M9, M11-M13

def blend(a: Column, b: Column, wa: float = 0.6) -> Column:
    """M5: ensemble blend 0.6 a + 0.4 b."""
    return wa * a + (1 - wa) * b


def prediction_frame(scored: DataFrame, customers: DataFrame, p: str = "churn_probability") -> DataFrame:
    """M9: probability clipped to [0, 1], right-closed risk level, segment from persona."""
    pc = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    return (scored.select("customer_id", pc.alias("churn_probability"))
            .join(customers.select("customer_id", F.lower("persona").alias("segment")), "customer_id", "left")
            .withColumn("risk_level", risk_level_right_closed("churn_probability")))


def local_explanations(df: DataFrame, features: list[str], label: str = "churn_label", top_n: int = 10,
                       top_k: int = 3) -> tuple[DataFrame, DataFrame]:
    """M11 + M12 (re-aimed): logistic-regression attribution coef * (x - mean).

    Returns the long top-N-customers x top-K-features table and the global mean |contribution|
    with cumulative share. Coefficients are a p-vector (broadcast as literals).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    x = va.transform(df.na.fill(0.0, features)).withColumn("label", F.col(label).cast("double"))
    lr = LogisticRegression(maxIter=50, regParam=0.01).fit(x)
    coef = lr.coefficients.toArray().tolist()
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    scored = lr.transform(x).withColumn("p", vector_to_array("probability")[1])
    contrib = F.array(*[F.struct(F.lit(c).alias("feature"),
                                 (F.lit(float(w)) * (F.col(c) - F.lit(float(means[c] or 0.0)))).alias("contribution"))
                        for c, w in zip(features, coef)])
    long = scored.select("customer_id", "p", F.explode(contrib).alias("x")).select("customer_id", "p", "x.*")
    top_c = scored.orderBy(F.desc("p"), F.asc("customer_id")).limit(top_n).select("customer_id")
    lt = long.join(F.broadcast(top_c), "customer_id")
    from pyspark.sql import Window
    w = Window.partitionBy("customer_id").orderBy(F.desc(F.abs("contribution")), F.asc("feature"))
    local = lt.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    glob = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    return local, glob


def overlay_predictions(all_scores: DataFrame, test_scores: DataFrame, p: str = "churn_probability") -> DataFrame:
    """Score everyone, replace test rows by their ensemble score, mark split / source,
    re-derive the risk level; a missing counterpart score takes the mean."""
    mean_all = all_scores.agg(F.avg(p).alias("__m"))
    j = (all_scores.select("customer_id", F.col(p).alias("__all"))
         .join(test_scores.select("customer_id", F.col(p).alias("__test")), "customer_id", "full")
         .crossJoin(F.broadcast(mean_all)))
    is_test = F.col("__test").isNotNull()
    prob = F.when(is_test, F.col("__test")).otherwise(F.coalesce("__all", "__m"))
    return j.select("customer_id", prob.alias("churn_probability"),
                    F.when(is_test, "test").otherwise("train").alias("split"),
                    F.when(is_test, "ensemble_holdout").otherwise("full_model").alias("source"),
                    risk_level_right_closed(prob).alias("risk_level"))
