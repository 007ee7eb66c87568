"""Continuous drift monitor (D9 on a stream).

The edges and bin counts of the reference window are stored once as a baseline. Each micro-batch
of the stream adds its bin counts to those of all batches before it, takes the PSI and the level of every
feature from the counts, and writes an alert for each feature whose level has changed. What is kept is one
small table a batch (features x bins), named by the batch: a replayed batch starts from the table of the
batch before it and writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.config import DriftParams
from churnlens.operators import drift as dr

COUNTS = "feature string, bin int, pc long, batch_id int"
LEVELS = "feature string, psi double, level string, batch_id int"
ALERTS = "feature string, psi double, previous_level string, level string, batch_id int"


def write_baseline(ref: DataFrame, features: list[str], path: str, p: DriftParams = DriftParams()) -> None:
    """Edges and bin counts of the reference window: (feature, edges, bin, rc)."""
    rows = dr.bin_edges(ref, features, p.n_bins).collect()          # features x bins
    spark = ref.sparkSession
    counts = dr.with_bin(dr.long_form(ref, features), rows).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("rc"))
    edges = spark.createDataFrame(rows, "feature string, edges array<double>")
    cells = dr.bin_grid(spark, rows).join(counts, ["feature", "bin"], "left").na.fill(0, ["rc"])
    cells.join(F.broadcast(edges), "feature").write.parquet(path)


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def _before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The table of the last batch before this one (empty for the first)."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path).filter(F.col("batch_id") < batch_id)
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.filter(F.col("batch_id") == (-1 if last is None else last))


def monitor_stream(values: DataFrame, baseline: str, folder: str, checkpoint: str, p: DriftParams = DriftParams(), once: bool = True):
    """Watch a stream of rows with the baseline's features as columns.

    Below ``folder`` stand ``counts`` (bin counts so far), ``levels`` and ``alerts``, each by batch.
    A feature is green before its first batch.
    """
    spark = values.sparkSession
    base = spark.read.parquet(baseline)
    rows = base.select("feature", "edges").distinct().collect()     # one row a feature
    features = [r["feature"] for r in rows]
    reference = spark.createDataFrame(base.select("feature", "bin", "rc").collect(), "feature string, bin int, rc long")

    def update(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        new = dr.with_bin(dr.long_form(batch, features), rows).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("pc"))
        old = _before(s, f"{folder}/counts", COUNTS, batch_id).select("feature", "bin", "pc")
        _put(old.unionByName(new).groupBy("feature", "bin").agg(F.sum("pc").alias("pc")), f"{folder}/counts", batch_id)
        so_far = s.read.schema(COUNTS).parquet(f"{folder}/counts").filter(F.col("batch_id") == batch_id).drop("batch_id")
        psi = dr.psi_of_counts(reference.join(so_far, ["feature", "bin"], "left"), p)
        _put(psi.withColumn("level", dr.psi_level(F.col("psi"), p)), f"{folder}/levels", batch_id)
        now = s.read.schema(LEVELS).parquet(f"{folder}/levels").filter(F.col("batch_id") == batch_id).drop("batch_id")
        was = _before(s, f"{folder}/levels", LEVELS, batch_id).select("feature", F.col("level").alias("was"))
        changed = now.join(was, "feature", "left").withColumn("previous_level", F.coalesce("was", F.lit("green")))
        _put(changed.filter("level <> previous_level").select("feature", "psi", "previous_level", "level"), f"{folder}/alerts", batch_id)

    w = values.select(*features).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
    if once:
        q.awaitTermination()
    return q


def current_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The levels after the last batch."""
    rows = spark.read.schema(LEVELS).parquet(f"{folder}/levels")
    last = rows.agg(F.max("batch_id").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch_id") == F.col("last")).drop("last", "batch_id").withColumn(
        "is_drifted", F.col("level") == "red")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a level, by batch."""
    return spark.read.schema(ALERTS).parquet(f"{folder}/alerts")
