"""The domain mapping of ``churnlens.sources.tables`` written as DuckDB SQL.

Each oracle query is ``WITH <domain views> <body>``; :func:`oracle` also rounds the
listed double columns to 6 digits and casts the listed integer columns to BIGINT, the
same normalisation the catalog applies to the Spark result.
"""

from __future__ import annotations

PURCHASES = """purchases AS (
  SELECT o_custkey AS customer_id, o_orderkey AS order_id, 'purchase' AS event_type,
         CAST(o_orderdate AS DATE) AS event_date, o_totalprice AS amount
  FROM orders)"""

ACTIVITY = """activity AS (
  SELECT event_id, user_id AS customer_id,
    CASE WHEN event_type = 'view' THEN 'page_view'
         WHEN event_type = 'purchase' THEN 'purchase'
         WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'add_to_cart' ELSE 'search' END
         WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'cs_contact' ELSE 'remove_from_cart' END
         WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'coupon_use' ELSE 'review' END
    END AS event_type,
    CAST(ts AS DATE) AS event_date, ts AS "timestamp",
    CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS amount,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS session_duration,
    CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'push' WHEN 2 THEN 'sms' END AS marketing_channel,
    CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 3 = 0 THEN 'conversion'
         WHEN event_id % 3 = 1 THEN 'no_response' ELSE 'adverse' END AS marketing_response
  FROM events)"""

CUSTOMERS = """cust AS (
  SELECT c.c_custkey AS customer_id, c.c_mktsegment AS persona,
         CAST(f.first_date - CAST(c.c_custkey % 45 AS INTEGER) AS DATE) AS signup_date,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'treatment' ELSE 'control' END AS treatment_group,
         CASE WHEN f.last_date IS NULL THEN 1
              WHEN date_diff('day', f.last_date, (SELECT max(event_date) FROM purchases)) >= 365 THEN 1
              ELSE 0 END AS churn_label,
         c.c_acctbal AS acctbal
  FROM customer c
  LEFT JOIN (SELECT customer_id, min(event_date) AS first_date, max(event_date) AS last_date
             FROM purchases GROUP BY customer_id) f ON c.c_custkey = f.customer_id)"""

SCORES = """scores AS (
  SELECT c.c_custkey AS customer_id, lower(c.c_mktsegment) AS segment,
         ((c.c_custkey * 7919) % 1000) / 1000.0 AS churn_probability,
         (((c.c_custkey * 104729) % 401) - 100) / 1000.0 AS uplift_score,
         coalesce(t.tot, 0.0) / 10.0 AS clv,
         CASE WHEN c.c_custkey % 3 = 0 THEN 5000.0 WHEN c.c_custkey % 3 = 1 THEN 10000.0 ELSE 20000.0 END
           AS cost_per_action,
         CAST(c.c_custkey % 2 AS INTEGER) AS push_opt_in,
         CAST((c.c_custkey + 1) % 3 <> 0 AS INTEGER) AS email_opt_in,
         CASE WHEN c.c_custkey % 2 = 0 THEN 1 ELSE 0 END AS is_treatment
  FROM customer c
  LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS tot FROM orders GROUP BY o_custkey) t
    ON c.c_custkey = t.o_custkey)"""

DOMAIN = {"purchases": PURCHASES, "activity": ACTIVITY, "cust": CUSTOMERS, "scores": SCORES}
# views a domain view needs before it
_DEPS = {"cust": ["purchases"]}


def oracle(body: str, *, views: list[str], ctes: list[str] | None = None,
           doubles: list[str] | None = None, ints: list[str] | None = None) -> str:
    """Assemble ``WITH views, ctes body`` and normalise the listed columns."""
    order: list[str] = []
    for v in views:
        for d in _DEPS.get(v, []):
            if d not in order:
                order.append(d)
        if v not in order:
            order.append(v)
    parts = [DOMAIN[v] for v in order] + list(ctes or [])
    sql = ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
    repl = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in (doubles or [])]
    repl += [f"CAST({c} AS BIGINT) AS {c}" for c in (ints or [])]
    if repl:
        sql = f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS q"
    return sql
