"""Structured Streaming scoring.

Requests are rows ``(message_id, customer_id, features JSON, timestamp, request_type)``.
The scorer reads them with ``readStream``, parses the JSON permissively (bad JSON ->
empty map), scores with the same column expressions as the batch path, and writes
through ``foreachBatch`` into a Parquet table partitioned by batch id with
overwrite-per-partition: a replayed micro-batch rewrites its own partition, so with the
checkpoint (offset commit = acknowledgement) the sink is effectively exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators.scoring import NUMERIC_FEATURES, score_batch

REQUEST_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("features", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("request_type", T.StringType())])
RESPONSE_COLUMNS = ["customer_id", "churn_probability", "risk_level", "recommended_action", "model_type",
                    "scored_at", "request_message_id"]


def write_requests(df: DataFrame, path: str, id_col: str = "message_id") -> str:
    """T5: requests need a customer id; every other column is JSON-encoded into ``features``."""
    feats = [c for c in df.columns if c not in ("customer_id", id_col, "timestamp", "request_type")]
    out = df.filter(F.col("customer_id").isNotNull()).select(
        F.col(id_col).cast("string").alias("message_id"), F.col("customer_id").cast("string").alias("customer_id"),
        F.to_json(F.struct(*feats)).alias("features"),
        F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.coalesce(F.col("request_type"), F.lit("score")).alias("request_type")
        if "request_type" in df.columns else F.lit("score").alias("request_type"))
    out.write.mode("overwrite").parquet(path)
    return path


def parse_requests(raw: DataFrame) -> DataFrame:
    """T4: JSON features (default {} on bad JSON), request type default ``score``, event time."""
    m = F.from_json(F.col("features"), T.MapType(T.StringType(), T.DoubleType()), {"mode": "PERMISSIVE"})
    m = F.coalesce(m, F.create_map().cast("map<string,double>"))
    out = raw.withColumn("__f", m).withColumn("request_type", F.coalesce("request_type", F.lit("score"))) \
        .withColumn("event_time", F.to_timestamp("timestamp"))
    for c in NUMERIC_FEATURES:
        out = out.withColumn(c, F.col("__f")[F.lit(c)])
    return out.drop("__f")


#: Bytes of request files that a micro-batch reads.
BATCH_BYTES = 1 << 30


def read_requests(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """T4: streaming source of request files. A micro-batch is bounded by ``BATCH_BYTES``, so many small files are
    no more micro-batches than few large ones; with ``max_files`` by the number of files."""
    bound = ("maxBytesPerTrigger", str(BATCH_BYTES)) if max_files is None else ("maxFilesPerTrigger", str(max_files))
    raw = spark.readStream.schema(REQUEST_SCHEMA).option(*bound).parquet(path)
    return parse_requests(raw)


def dedup_requests(stream: DataFrame, keep: str = "1 day") -> DataFrame:
    """Each message id once. The state of an id is kept for ``keep`` after its arrival: the
    watermark follows the arrival time, so no request is late whatever its own time."""
    return (stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", keep)
            .dropDuplicatesWithinWatermark(["message_id"]).drop("arrived"))


def responses(parsed: DataFrame, no_purchase_days: int = 30, no_login_days: int = 60) -> DataFrame:
    """T3 on a (micro-)batch: the 7-column response rows."""
    s = score_batch(parsed, no_purchase_days, no_login_days, scored_at=F.col("event_time"))
    return s.select("customer_id", "churn_probability", "risk_level", "recommended_action", "model_type",
                    F.date_format("scored_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scored_at"),
                    F.col("message_id").alias("request_message_id"))


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = True,
                 no_purchase_days: int = 30, no_login_days: int = 60, dedup: bool = True):
    """Read -> (dedup) -> score -> write per micro-batch; ``once`` drains what is
    available (``availableNow``) and stops."""
    stream = read_requests(spark, source)
    if dedup:
        stream = dedup_requests(stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = responses(batch, no_purchase_days, no_login_days).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    q = w.start()
    if once:
        q.awaitTermination()
    return q


def _upserts(df: DataFrame, sink: str, checkpoint: str):
    """Drain an aggregate in update mode: the rows a micro-batch changed go to the batch's own
    partition, which a replayed batch writes again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))

    q = (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_throughput(spark: SparkSession, source: str, sink: str, checkpoint: str, minutes: int = 15,
                      keep: str | None = None):
    """T10 (stream): tumbling windows over event time; every window is written when it changes.

    Without ``keep`` every request counts, however late, and the state keeps one row a window for ever. With
    it (an interval, as ``"7 days"``) a window leaves the state once it is so much older than the newest request, and
    requests for it that come later are not counted; as what is late follows from the micro-batches, each file is one."""
    requests = read_requests(spark, source, None if keep is None else 1)
    if keep is not None:
        requests = requests.withWatermark("event_time", keep)
    g = (requests.groupBy(F.window("event_time", f"{minutes} minutes").alias("w"))
         .agg(F.count(F.lit(1)).alias("requests")))
    return _upserts(g.select(F.col("w.start").alias("timestamp"), "requests"), sink, checkpoint)


def throughput_table(spark: SparkSession, sink: str, minutes: int = 15) -> DataFrame:
    """The windows as they stand: counts only grow, so the largest is the last."""
    rows = spark.read.schema("timestamp timestamp, requests long, batch_id int").parquet(sink)
    return rows.groupBy("timestamp").agg(F.max("requests").alias("requests")).withColumn(
        "requests_per_minute", F.round(F.col("requests") / float(minutes), 4))


def latest_prediction_stream(responses_stream: DataFrame, sink: str, checkpoint: str):
    """T9 (stream): per customer the prediction of the latest time (of equal times the larger),
    whatever the order of arrival; the state is one row a customer."""
    g = responses_stream.groupBy("customer_id").agg(F.max(F.struct("scored_at", "churn_probability")).alias("l"))
    return _upserts(g.select("customer_id", "l.scored_at", "l.churn_probability"), sink, checkpoint)


def latest_prediction_table(spark: SparkSession, sink: str, now=None, ttl_seconds: int | None = None) -> DataFrame:
    """One row a customer from the stream's sink, without those older than the TTL at ``now``."""
    rows = spark.read.schema("customer_id string, scored_at timestamp, churn_probability double, batch_id int").parquet(sink)
    out = rows.groupBy("customer_id").agg(F.max(F.struct("scored_at", "churn_probability")).alias("l")).select(
        "customer_id", "l.churn_probability", "l.scored_at")
    if ttl_seconds is None:
        return out
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("scored_at")
    return out.filter(age <= ttl_seconds)
