"""A learner's fits and scorings read the training rows once, whatever they are joined from."""
import pytest
from pyspark.sql import functions as F

from churnlens.operators import uplift as up


@pytest.mark.parametrize("learner", sorted(up.LEARNERS))
def test_training_rows_are_made_once(spark, learner):
    made = spark.sparkContext.accumulator(0)

    def rows(parts):
        for part in parts:
            made.add(len(part))
            yield part
    df = spark.range(200).mapInPandas(rows, "id long").select(
        F.col("id").alias("customer_id"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("is_treatment"),
        (F.col("id") * 7 % 5 < 2).cast("int").alias("churn_label"))
    out = up.LEARNERS[learner](df, ["x"])
    assert out.count() == 200 and made.value == 200
