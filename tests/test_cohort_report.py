"""The long cohort report on a small frame, and the feature store's formats."""
import uuid

import pytest

from churnlens.operators import cohort as co
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources import io


def test_report_levels(spark):
    rows = [(f"a{i}", "2024-01", p, 10.0) for i in range(6) for p in range(3) if p < 1 + i // 2] + [("a0", "2024-01", 0, 4.0), ("a5", "2024-01", 14, 6.0)]
    rows += [(f"b{i}", "2024-02", 0, 20.0) for i in range(5)] + [("b0", "2024-02", 1, None)]
    rows += [("c0", "2024-03", 0, 99.0), (None, "2024-01", 0, 1.0), ("x", None, 0, 1.0), ("y", "2024-01", None, 1.0)]
    df = spark.createDataFrame(rows, "customer_id string, cohort string, cohort_period int, revenue double")
    by = {(r.level, r.cohort, r.cohort_period): r for r in co.cohort_report(df).collect()}
    assert {k[0] for k in by} == {"cell", "period", "cohort", "all"} and not any(k[1] == "2024-03" for k in by)
    cell = [by["cell", "2024-01", p] for p in range(3)]
    assert [c.customers for c in cell] == [6, 4, 2] and [c.events for c in cell] == [7, 4, 2]
    assert [c.retention for c in cell] == pytest.approx([1, 4 / 6, 2 / 6])
    assert [c.period_churn for c in cell] == pytest.approx([0, 1 / 3, 1 / 2]) and [c.cumulative_revenue for c in cell] == [64, 104, 124]
    assert by["cell", "2024-02", 2].customers == 0 and by["cell", "2024-02", 1].avg_order_value is None
    late = by["cell", "2024-01", 14]                    # beyond the last period: counted, without retention
    assert (late.customers, late.revenue, late.retention) == (1, 6.0, None)
    assert by["period", None, 1].retention == pytest.approx((4 / 6 + 1 / 5) / 2) and by["period", None, 1].customers == 5
    one = by["cohort", "2024-01", None]
    assert (one.customers, one.max_period, one.half_life) == (6, 14, 2)
    assert one.avg_lifetime_periods == pytest.approx((0 + 0 + 1 + 1 + 2 + 14) / 6)
    whole = by["all", None, None]
    assert whole.customers == 11 and whole.events == 14 + 6 and whole.revenue == 130 + 100


def test_feature_store_formats(spark):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store_{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, 2.5), (2, None)], "customer_id long, x double")
    for fmt in ("parquet", "csv"):
        path = io.save_feature_store(df, f"{base}/{fmt}", fmt)
        assert sorted((r.customer_id, r.x) for r in io.load_feature_store(spark, path).collect()) == [(1, 2.5), (2, None)]
    with pytest.raises(FileNotFoundError):
        io.load_feature_store(spark, f"{base}/none")
