"""Request parsing, validation and the streaming scorer."""
import time
import uuid

from pyspark.sql import functions as F

from churnlens.operators import scoring as scr
from churnlens.session import ensure_checkpoint_dir
from churnlens.streaming import scorer as st


def test_bad_json_takes_defaults(spark):
    raw = spark.createDataFrame([("m1", "c1", "{not json", "2024-01-01T00:00:00", None),
                                 ("m2", "c2", '{"days_since_last_purchase": 60, "frequency": 0}',
                                  "2024-01-01T00:05:00", "score")], st.REQUEST_SCHEMA)
    p = st.parse_requests(raw)
    r = {x["request_message_id"]: x for x in st.responses(p, 30, 60).collect()}
    # empty features: 0 / 0 recency risk, frequency 5 -> .1, sessions 10 -> .075, cart .2 -> .03
    assert abs(r["m1"]["churn_probability"] - 0.205) < 1e-12
    # 60 days since purchase caps at 2 -> .6; frequency 0 takes the default 5
    assert abs(r["m2"]["churn_probability"] - 0.805) < 1e-12
    assert {x["request_type"] for x in p.collect()} == {"score"}


def test_validate_features_reports_errors(spark):
    df = spark.createDataFrame([("c1", None, "7"), ("c2", 1.0, None)], "customer_id string, recency double, monetary string")
    errs = {r["customer_id"]: r["errors"] for r in scr.validate_features(df).collect()}
    assert "Missing required feature: frequency" in errs["c1"] and "Missing required feature: frequency" in errs["c2"]
    # A null is valid, text is not, even if it reads as a number.
    assert not any("recency" in e for es in errs.values() for e in es)
    assert "Feature 'monetary' must be numeric, got str" in errs["c1"] and not any("monetary" in e for e in errs["c2"])
    bad_id = scr.validate_features(spark.createDataFrame([(1.5,)], "customer_id double")).first()["errors"]
    assert "customer_id must be str or int, got float" in bad_id


def _files(spark, base, *batches):
    """Request files with ascending modification times, one micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, st.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(base)
        time.sleep(1.1)
    return base


def test_late_and_out_of_order_requests_are_all_scored(spark):
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/t_" + uuid.uuid4().hex
    row = lambda m, c, t: (m, c, "{}", f"2024-01-01T{t}:00", "score")
    src = _files(spark, base + "/src", [row("m1", "a", "10:00")], [row("m2", "b", "11:00"), row("m1", "a", "10:00")],
                 [row("m3", "a", "09:00"), row("m4", "c", "12:00"), row("m2", "b", "11:00")])
    st.score_stream(spark, src, base + "/sink", base + "/ck", once=True)
    got = [r["request_message_id"] for r in spark.read.parquet(base + "/sink").collect()]
    assert sorted(got) == ["m1", "m2", "m3", "m4"]
    # A second drain has nothing new; its sink stays as it is.
    st.score_stream(spark, src, base + "/sink", base + "/ck", once=True)
    assert spark.read.parquet(base + "/sink").count() == 4
    st.stream_throughput(spark, src, base + "/tp", base + "/tpck")
    windows = {r["timestamp"].hour: r["requests"] for r in st.throughput_table(spark, base + "/tp").collect()}
    assert windows == {10: 2, 11: 2, 9: 1, 12: 1}
    resp = st.responses(st.read_requests(spark, src)).withColumn("scored_at", F.to_timestamp("scored_at"))
    st.latest_prediction_stream(resp, base + "/lp", base + "/lpck")
    last = {r["customer_id"]: r["scored_at"].hour for r in st.latest_prediction_table(spark, base + "/lp").collect()}
    assert last == {"a": 10, "b": 11, "c": 12}     # a's 09:00, which came last, does not win
    kept = st.latest_prediction_table(spark, base + "/lp", "2024-01-01 12:30:00", 3600).collect()
    assert [r["customer_id"] for r in kept] == ["c"]


def test_stream_drains_once_and_dedups(spark):
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/t_" + uuid.uuid4().hex[:6]
    rows = [("m1", "c1", "{}", "2024-01-01T00:00:00", "score"), ("m1", "c1", "{}", "2024-01-01T00:00:00", "score"),
            ("m2", "c2", "{}", "2024-01-01T00:01:00", "score")]
    spark.createDataFrame(rows, st.REQUEST_SCHEMA).write.parquet(base + "/src")
    st.score_stream(spark, base + "/src", base + "/sink", base + "/ck", once=True)
    out = spark.read.parquet(base + "/sink")
    assert sorted(r["request_message_id"] for r in out.collect()) == ["m1", "m2"]
    assert set(out.columns) >= set(st.RESPONSE_COLUMNS)
    _ = F


def test_windows_leave_the_state_after_their_time(spark):
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/t_" + uuid.uuid4().hex
    row = lambda m, t: (m, "c", "{}", f"2024-01-01T{t}:00", "score")
    src = _files(spark, base + "/src", [row("m1", "08:00")], [row("m2", "12:00")], [row("m5", "12:10")],
                 [row("m3", "11:40"), row("m4", "08:05")])
    q = st.stream_throughput(spark, src, base + "/tp", base + "/tpck", keep="1 hour")
    windows = {(r["timestamp"].hour, r["timestamp"].minute): r["requests"] for r in st.throughput_table(spark, base + "/tp").collect()}
    assert windows == {(8, 0): 1, (12, 0): 2, (11, 30): 1}        # m4 came long after its window
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
