"""Driver contract and a sample of the DuckDB oracle comparison at sf0.001."""
import math
import os

import duckdb
import pytest

from tests.conftest import SF

SAMPLE = ["segment_summary", "rfm_scores", "feature_matrix", "retention", "journey_funnel", "balance_check",
          "psi", "ks_statistic", "budget_allocation", "channel_allocation", "recommendations", "auuc",
          "kaplan_meier", "concordance", "stream_scores", "throughput", "clv_ranking", "roc_curve"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return v


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"segment", "count", "percentage"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer orders events lineitem".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, con, name):
    import __spark_entry__ as e
    q, o = e.queries()[name], e.oracle_sql()[name]
    sdf = q(spark, SF)
    srows, scols = [tuple(r) for r in sdf.collect()], sdf.columns
    rel = con.sql(o)
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    a = sorted((tuple(_norm(r[scols.index(c)]) for c in order) for r in srows), key=repr)
    b = sorted((tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    assert a == b


def test_every_oracle_key_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert not os.path.basename(SF).startswith("x")
