"""Model selection fits every setting once a fold and refits only the best one."""
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from churnlens.operators import models as md


def test_only_the_best_setting_is_refitted(spark, monkeypatch):
    fits = []

    def counted(cls):
        fit = cls.fit

        def run(self, dataset, params=None):
            fits.append((cls.__name__, self.getMaxDepth()))
            return fit(self, dataset, params)
        monkeypatch.setattr(cls, "fit", run)
    counted(GBTClassifier)
    counted(RandomForestClassifier)
    df = spark.range(120).select(
        F.col("id").alias("customer_id"), (F.col("id") * 37 % 101).cast("double").alias("x"),
        (F.col("id") * 53 % 89).cast("double").alias("y")).withColumn(
        "churn_label", ((F.col("x") + F.col("customer_id") % 7 * 8) > 70).cast("int"))
    model, table = md.fit_churn(df, ["x", "y"], k=2)
    rows = table.collect()
    assert [(r["family"], r["setting"]) for r in rows] == [
        *[("gbt", f"{{'maxDepth': {d}}}") for d in (2, 3, 4)], *[("random_forest", f"{{'maxDepth': {d}}}") for d in (3, 5, 7)]]
    settings = [*[("GBTClassifier", d) for d in (2, 3, 4)], *[("RandomForestClassifier", d) for d in (3, 5, 7)]]
    best = settings[max(range(6), key=lambda i: rows[i]["mean_auc"])]
    assert sorted(fits) == sorted([*settings * 2, best])
    assert model.stages[-1].getMaxDepth() == best[1]
    assert md.score(model, df).filter(F.col("churn_probability").between(0, 1)).count() == 120
