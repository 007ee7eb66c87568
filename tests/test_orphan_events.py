"""Events are checked against all customers, churned ones included."""
import duckdb

from churnlens.plans.catalog import ORACLE, QUERIES, load_all


def test_events_of_churned_customers_are_no_orphans(spark, tmp_path):
    load_all()
    for name, sql in {
        "customer": "SELECT k AS c_custkey, 'x' AS c_mktsegment, 0.0 AS c_acctbal FROM unnest([1, 2, 3]) t(k)",
        # customer 2 ordered long before the last order and customer 3 never: both are churned
        "orders": "SELECT k AS o_orderkey, k AS o_custkey, d AS o_orderdate, 1.0 AS o_totalprice FROM "
                  "(VALUES (1, TIMESTAMP '2024-01-01'), (2, TIMESTAMP '2020-01-01')) t(k, d)",
        "events": "SELECT k AS event_id, TIMESTAMP '2024-01-02' AS ts, k AS user_id, 'view' AS event_type, 1.0 AS value, "
                  "'{\"k\": 1}' AS props FROM unnest([1, 2, 3, 4]) t(k)",
    }.items():
        duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = QUERIES["orphan_events"](spark, str(tmp_path)).collect()
    assert [r.customer_id for r in got] == [4]
    con = duckdb.connect()
    for name in ("customer", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert [r[1] for r in con.execute(ORACLE["orphan_events"]).fetchall()] == [4]
