"""Stream state with a lifetime (T9, T14 as streams).

``transformWithState`` keeps one value a customer (its latest prediction) and one bounded list a shard (the last
responses) on the state store. A prediction leaves the state by a timer in event time once it is
older than the TTL, so the state holds live customers only. Each micro-batch writes its changes to the
batch's own partition: a replayed batch writes the same rows again.

The processors need Spark's RocksDB state store. :func:`state_session` gives a session of the same
application that has it set; the caller's session keeps its settings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from churnlens.functions.prefix import global_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVE, EXPIRED, KEPT, DROPPED = "live", "expired", "kept", "dropped"
LATEST_SCHEMA = "customer_id string, scored_at timestamp, churn_probability double, status string"
RECENT_SCHEMA = "shard int, scored_at timestamp, message_id string, customer_id string, churn_probability double, status string"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for stateful streams."""
    out = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(k, None) is not None:
            out.conf.set(k, spark.conf.get(k))
    out.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return out


def _micros(t: pd.Timestamp) -> int:
    return int(t.value // 1000)


class LatestWithTtl(StatefulProcessor):
    """The latest prediction of a customer, dropped when it is older than the TTL.

    Of equal times the larger probability counts; an older record never replaces a newer one. A
    timer a millisecond after a record's time fires when the watermark, which trails the newest
    record by the TTL, has passed it: the record is then older than the TTL.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, p double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = old = tuple(self.latest.get()) if self.latest.exists() else None
        for pdf in rows:
            for at, p in zip(pdf["scored_at"], pdf["churn_probability"]):
                mine = (_micros(pd.Timestamp(at)), float(p))
                best = mine if best is None or mine > best else best
        if best is None or best == old:
            return
        if old is not None:
            self.handle.deleteTimer(old[0] // 1000 + 1)
        self.latest.update(best)
        self.handle.registerTimer(best[0] // 1000 + 1)
        yield self._row(key, best, LIVE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latest.exists():
            return
        old = tuple(self.latest.get())
        if old[0] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield self._row(key, old, EXPIRED)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, value, status: str) -> pd.DataFrame:
        return pd.DataFrame({"customer_id": [key[0]], "scored_at": [pd.Timestamp(value[0], unit="us")],
                             "churn_probability": [value[1]], "status": [status]})


class LastN(StatefulProcessor):
    """The last n responses of a shard by time and message id; the list never holds more than n."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "at long, message_id string, customer_id string, p double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = {tuple(x) for x in self.last.get()} if self.last.exists() else set()
        now = set(old)
        for pdf in rows:
            now |= {(_micros(pd.Timestamp(at)), m, c, float(p)) for at, m, c, p in
                    zip(pdf["scored_at"], pdf["message_id"], pdf["customer_id"], pdf["churn_probability"])}
            now = set(sorted(now)[-self.n:])
        if now == old:
            return
        self.last.put(sorted(now))
        changed = [(x, KEPT) for x in sorted(now - old)] + [(x, DROPPED) for x in sorted(old - now)]
        yield pd.DataFrame({
            "shard": [key[0]] * len(changed), "scored_at": [pd.Timestamp(x[0], unit="us") for x, _ in changed],
            "message_id": [x[1] for x, _ in changed], "customer_id": [x[2] for x, _ in changed],
            "churn_probability": [x[3] for x, _ in changed], "status": [s for _, s in changed]})

    def close(self) -> None:
        pass


def _drain(changes: DataFrame, sink: str, checkpoint: str):
    """Run a stream to its end; a micro-batch's changes go to its own partition."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))

    q = (changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_with_ttl_stream(predictions: DataFrame, sink: str, checkpoint: str, ttl_seconds: int):
    """T9 (stream): customers with a prediction not older than the TTL at the newest record.

    ``predictions``: a stream of (customer_id, scored_at, churn_probability) in a
    :func:`state_session`; rows with a null are left out.
    """
    rows = predictions.select(F.col("customer_id").cast("string").alias("customer_id"), F.col("scored_at").cast("timestamp").alias("scored_at"),
                              F.col("churn_probability").cast("double").alias("churn_probability"))
    rows = rows.filter("customer_id IS NOT NULL AND scored_at IS NOT NULL AND churn_probability IS NOT NULL")
    changes = (rows.withWatermark("scored_at", f"{ttl_seconds} seconds").groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=LatestWithTtl(), outputStructType=LATEST_SCHEMA, outputMode="Update", timeMode="EventTime"))
    return _drain(changes, sink, checkpoint)


def live_predictions(spark: SparkSession, sink: str) -> DataFrame:
    """The customers whose last change is a live prediction."""
    rows = spark.read.schema(LATEST_SCHEMA + ", batch_id int").parquet(sink)
    last = rows.groupBy("customer_id").agg(F.max(F.struct("batch_id", F.col("status") == EXPIRED, "scored_at", "churn_probability",
                                                          "status")).alias("l"))
    return last.filter(F.col("l.status") == LIVE).select("customer_id", "l.scored_at", "l.churn_probability")


def recent_responses_stream(responses: DataFrame, sink: str, checkpoint: str, n: int, shards: int = 16):
    """T14 (stream): the last ``n`` responses. Messages are dealt into shards by a hash, each shard keeps its last n in a
    list, so no key holds the whole stream; ``responses`` as for T9 with a ``message_id``."""
    rows = responses.select(F.col("message_id").cast("string").alias("message_id"), F.col("customer_id").cast("string").alias("customer_id"),
                            F.col("scored_at").cast("timestamp").alias("scored_at"), F.col("churn_probability").cast("double").alias("churn_probability"))
    rows = rows.filter("message_id IS NOT NULL AND scored_at IS NOT NULL AND churn_probability IS NOT NULL").withColumn(
        "shard", F.pmod(F.xxhash64("message_id"), F.lit(shards)).cast("int"))
    changes = rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=LastN(n), outputStructType=RECENT_SCHEMA, outputMode="Update", timeMode="None")
    return _drain(changes, sink, checkpoint)


def recent_responses(spark: SparkSession, sink: str, n: int) -> DataFrame:
    """The last ``n`` of what the shards keep (at most n a shard)."""
    rows = spark.read.schema(RECENT_SCHEMA + ", batch_id int").parquet(sink)
    value = ["scored_at", "message_id", "customer_id", "churn_probability"]
    last = rows.groupBy(*value).agg(F.max(F.struct("batch_id", "status")).alias("l")).filter(F.col("l.status") == KEPT).drop("l")
    ranked = global_order(last, [("scored_at", False), ("message_id", False), ("churn_probability", False)], rank_col="__r")
    return ranked.filter(F.col("__r") <= n).drop("__r")
