"""Out-of-fold uplift scores: folds, fits that do not see their rows, and the area they reach."""
import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import uplift as up


@pytest.fixture(autouse=True)
def small_trees(monkeypatch):
    """Fewer trees than the operators use: the effect is a single threshold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    monkeypatch.setattr(up, "_gbt", lambda features, seed=42: Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol="label", seed=seed, maxIter=4, maxDepth=3)]))


def frame(spark, n=1200, seed=5):
    """Treatment helps customers with x > 0 and harms the others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, noise, t = rng.uniform(-1, 1), rng.uniform(-1, 1), i % 2
        p = 0.5 - 0.35 * (x > 0) * t + 0.25 * (x <= 0) * t
        rows.append((i, x, noise, t, int(rng.random() < p)))
    return spark.createDataFrame(rows, "customer_id long, x double, noise double, is_treatment int, churn_label int")


def test_folds_have_their_share_of_each_arm_and_label(spark):
    counts = up.uplift_folds(frame(spark), 4).groupBy("is_treatment", "churn_label", "fold").count().collect()
    sizes = {}
    for r in counts:
        sizes.setdefault((r.is_treatment, r.churn_label), []).append(r["count"])
    assert all(len(v) == 4 and max(v) - min(v) <= 1 for v in sizes.values()) and len(sizes) == 4


def test_out_of_fold_scores_find_the_effect(spark):
    df = frame(spark)
    table = {r.learner: r for r in up.compare_fitted_learners(df, ["x", "noise"], k=2).collect()}
    assert set(table) == {"t_learner", "s_learner"}
    random_scores = df.withColumn("uplift_score", F.rand(1))
    chance = up.auuc(random_scores).first().auuc
    for r in table.values():
        assert r.auuc > chance + 0.05
    scores = up.cross_fit_uplift(df, ["x", "noise"], "s_learner", 2)
    assert scores.count() == scores.select("customer_id").distinct().count() == df.count()


def test_scores_do_not_see_their_own_rows(spark):
    """Labels that a unique feature gives away are not recovered out of fold."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, float(i * 7919 % 1009), i % 2, rng.randint(0, 1)) for i in range(400)],
                               "customer_id long, code double, is_treatment int, churn_label int")
    inside = up.auuc(up.uplift_t(df, ["code"]).select("customer_id", "uplift_score").join(df, "customer_id")).first().auuc
    outside = up.auuc(up.cross_fit_uplift(df, ["code"], "t_learner", 2).select("customer_id", "uplift_score").join(df, "customer_id")).first().auuc
    assert inside > outside + 0.1 and abs(outside) < 0.15


def test_one_arm_is_an_error(spark):
    with pytest.raises(ValueError):
        up.cross_fit_uplift(frame(spark, 40).withColumn("is_treatment", F.lit(1)), ["x"], k=2)
