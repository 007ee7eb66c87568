"""Micro-batches follow the bytes of the request files, not their number."""
import uuid

from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir
from churnlens.streaming import scorer as st


def test_many_small_files_are_one_micro_batch(spark, monkeypatch):
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/t_" + uuid.uuid4().hex
    rows = [(f"m{i}", f"c{i}", "{}", f"2024-01-01T{i:02d}:00:00", "score") for i in range(6)]
    spark.createDataFrame(rows, st.REQUEST_SCHEMA).repartition(6).write.parquet(base + "/src")
    st.stream_throughput(spark, base + "/src", base + "/tp", base + "/tpck")
    assert spark.read.parquet(base + "/tp").select("batch_id").distinct().count() == 1
    assert sorted((r.timestamp.hour, r.requests) for r in st.throughput_table(spark, base + "/tp").collect()) == [(i, 1) for i in range(6)]
    # more bytes than the bound are several micro-batches, with the same windows
    monkeypatch.setattr(st, "BATCH_BYTES", 1)
    st.stream_throughput(spark, base + "/src", base + "/tq", base + "/tqck")
    assert spark.read.parquet(base + "/tq").select("batch_id").distinct().count() > 1
    assert st.throughput_table(spark, base + "/tq").agg(F.sum("requests")).first()[0] == 6
