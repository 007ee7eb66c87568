"""State with a lifetime: expiry, late records, replays, bounded retention."""
import time
import uuid

from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir
from churnlens.streaming import state as ss

SCHEMA = "message_id string, customer_id string, scored_at timestamp, churn_probability double"


def _at(h):
    return f"2024-01-01 {h}:00"


def _source(spark, base, *batches):
    for rows in batches:
        df = spark.createDataFrame([(m, c, _at(t), p) for m, c, t, p in rows], "m string, c string, t string, p double")
        df.select(F.col("m").alias("message_id"), F.col("c").alias("customer_id"), F.to_timestamp("t").alias("scored_at"),
                  F.col("p").alias("churn_probability")).coalesce(1).write.mode("append").parquet(base)
        time.sleep(1.1)


def _stream(spark, base):
    return ss.state_session(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(base)


def _base(spark):
    return ensure_checkpoint_dir(spark).rstrip("/") + "/s_" + uuid.uuid4().hex


def test_predictions_expire_and_older_records_never_win(spark):
    base = _base(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    _source(spark, base + "/in", [("1", "a", "10:00", .1), ("2", "b", "10:00", .2), ("3", "a", "09:50", .9)],
            [("4", "a", "09:55", .8), ("5", "b", "10:20", .3), ("6", "b", "10:20", .25)],
            [("7", "c", "11:10", .4), ("x", None, "11:20", .4), ("y", "c", "11:00", None)], [("8", "d", "11:15", .5)])
    run = lambda: ss.latest_with_ttl_stream(_stream(spark, base + "/in"), base + "/out", base + "/ck", 3600)
    run()
    got = {r.customer_id: (str(r.scored_at)[11:16], r.churn_probability) for r in ss.live_predictions(spark, base + "/out").collect()}
    # At 11:15 the prediction of 10:00 is older than an hour, that of 10:20 is not.
    assert got == {"b": ("10:20", .3), "c": ("11:10", .4), "d": ("11:15", .5)}
    rows = spark.read.parquet(base + "/out").collect()
    assert [(r.customer_id, r.churn_probability) for r in rows if r.status == ss.EXPIRED] == [("a", .1)]
    assert not any(r.churn_probability in (.9, .8, .25) for r in rows)
    # A customer that has left the state comes back with its next prediction.
    _source(spark, base + "/in", [("9", "a", "11:16", .6)])
    run()
    assert {r.customer_id for r in ss.live_predictions(spark, base + "/out").collect()} == {"a", "b", "c", "d"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_replayed_batch_changes_nothing(spark):
    base = _base(spark)
    _source(spark, base + "/in", [("1", "a", "10:00", .1)], [("2", "a", "10:30", .2), ("3", "b", "10:30", .3)])
    ss.latest_with_ttl_stream(_stream(spark, base + "/in"), base + "/out", base + "/ck", 3600)
    want = sorted(map(tuple, spark.read.parquet(base + "/out").collect()))
    # The whole stream again, from a new checkpoint into the same sink: the batches write their partitions again.
    ss.latest_with_ttl_stream(_stream(spark, base + "/in"), base + "/out", base + "/ck2", 3600)
    assert sorted(map(tuple, spark.read.parquet(base + "/out").collect())) == want


def test_last_n_of_the_stream(spark):
    base = _base(spark)
    minute = lambda i: f"{10 + i // 60:02d}:{i % 60:02d}"
    rows = [(f"m{i:03d}", f"c{i % 7}", minute(i * 37 % 120), i / 200) for i in range(120)]
    _source(spark, base + "/in", rows[:50], rows[50:100], rows[100:] + rows[:5])
    ss.recent_responses_stream(_stream(spark, base + "/in"), base + "/out", base + "/ck", 10, shards=3)
    got = {r.message_id for r in ss.recent_responses(spark, base + "/out", 10).collect()}
    assert got == {m for m, _, t, _ in sorted(rows, key=lambda r: (r[2], r[0]))[-10:]}
    kept = spark.read.parquet(base + "/out").groupBy("shard", "message_id").agg(F.max(F.struct("batch_id", "status")).alias("l"))
    assert all(r["count"] <= 10 for r in kept.filter("l.status = 'kept'").groupBy("shard").count().collect())
