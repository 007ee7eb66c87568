"""The test tables mapped onto the retention domain.

The reference works on a ``customers`` table and an ``events`` table. The driver's data
is TPC-H-like, so the domain tables are derived here, always by deterministic column
expressions on the given tables (no made-up rows), so that the DuckDB oracle can state
the same mapping in SQL (``churnlens.plans.oracle_sql``):

* ``purchases``: ``orders`` as purchase events (customer, date, amount).
* ``activity_events``: ``events`` with the five source types mapped onto the eight
  domain types, a session duration from ``props`` and a marketing channel / response.
* ``customers``: ``customer`` with signup = first order date minus ``custkey % 45`` days,
  persona = market segment, arm = parity of the key, churn label from purchase recency.
* ``scores``: per-customer churn probability, uplift, CLV and action cost used by the
  budget, segment and recommendation operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping (must equal churnlens.plans.oracle_sql).
CHANNELS = ("email", "push", "sms")
RESPONSES = ("conversion", "no_response", "adverse")
CHURN_GAP_DAYS = 365
SIGNUP_SPREAD_DAYS = 45


_READ_CACHE: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given (read-only) input tables.

    The DataFrame is kept per application and path, so the file listing and the parquet
    footers are read once rather than at every reference; nothing is cached in memory,
    each use still scans (and prunes) the files.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _READ_CACHE.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READ_CACHE[key] = df
    return df


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as purchase events: ``customer_id, order_id, event_type, event_date, amount``."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.lit("purchase").alias("event_type"),
        F.to_date("o_orderdate").alias("event_date"),
        F.col("o_totalprice").alias("amount"),
    )


def _mapped_type(event_type: Column, event_id: Column) -> Column:
    even = (event_id % 2) == 0
    return (F.when(event_type == "view", F.lit("page_view"))
            .when(event_type == "purchase", F.lit("purchase"))
            .when(event_type == "click", F.when(even, "add_to_cart").otherwise("search"))
            .when(event_type == "error", F.when(even, "cs_contact").otherwise("remove_from_cart"))
            .when(event_type == "signup", F.when(even, "coupon_use").otherwise("review"))
            .otherwise(F.lit(None)))


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the 8-column domain schema plus ``event_id``."""
    e = read_table(spark, sf_dir, "events")
    etype = _mapped_type(F.col("event_type"), F.col("event_id"))
    chan_idx = F.col("event_id") % 4
    channel = (F.when(chan_idx == 0, CHANNELS[0]).when(chan_idx == 1, CHANNELS[1])
               .when(chan_idx == 2, CHANNELS[2]))
    resp_idx = F.col("event_id") % 3
    response = F.when(chan_idx == 3, F.lit(None)).otherwise(
        F.when(resp_idx == 0, RESPONSES[0]).when(resp_idx == 1, RESPONSES[1])
        .otherwise(RESPONSES[2]))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("customer_id"),
        etype.alias("event_type"),
        F.to_date(ts).alias("event_date"),
        ts.alias("timestamp"),
        F.when(etype == "purchase", F.col("value")).otherwise(F.lit(0.0)).alias("amount"),
        F.get_json_object("props", "$.k").try_cast("double").alias("session_duration"),
        channel.alias("marketing_channel"),
        response.alias("marketing_response"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer_id, persona, signup_date, treatment_group, churn_label, acctbal``."""
    c = read_table(spark, sf_dir, "customer")
    p = purchases(spark, sf_dir)
    per = p.groupBy("customer_id").agg(F.min("event_date").alias("first_date"),
                                       F.max("event_date").alias("last_date"))
    # the global last order date from the per-customer maxima: orders are aggregated once
    end = per.agg(F.max("last_date").alias("end_date"))
    out = (c.join(per, c.c_custkey == per.customer_id, "left")
           .crossJoin(F.broadcast(end))  # one row
           .select(
               F.col("c_custkey").alias("customer_id"),
               F.col("c_mktsegment").alias("persona"),
               F.date_sub("first_date", (F.col("c_custkey") % SIGNUP_SPREAD_DAYS).cast("int"))
               .alias("signup_date"),
               F.when(F.col("c_custkey") % 2 == 0, "treatment").otherwise("control")
               .alias("treatment_group"),
               F.when(F.col("last_date").isNull(), 1)
               .when(F.datediff("end_date", "last_date") >= CHURN_GAP_DAYS, 1)
               .otherwise(0).alias("churn_label"),
               F.col("c_acctbal").alias("acctbal"),
           ))
    return out


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer score table from deterministic expressions on the given tables.

    ``churn_probability`` in [0, 0.999], ``uplift_score`` in [-0.1, 0.3],
    ``clv`` = total order value / 10, ``cost_per_action`` in {5000, 10000, 20000},
    ``segment`` = lower-case market segment.
    """
    c = read_table(spark, sf_dir, "customer")
    o = read_table(spark, sf_dir, "orders")
    tot = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("tot"))
    k = F.col("c_custkey")
    return (c.join(tot, c.c_custkey == tot.o_custkey, "left")
            .select(
                k.alias("customer_id"),
                F.lower("c_mktsegment").alias("segment"),
                ((k * 7919) % 1000 / 1000.0).alias("churn_probability"),
                (((k * 104729) % 401 - 100) / 1000.0).alias("uplift_score"),
                (F.coalesce(F.col("tot"), F.lit(0.0)) / 10.0).alias("clv"),
                F.when(k % 3 == 0, 5000.0).when(k % 3 == 1, 10000.0).otherwise(20000.0)
                .alias("cost_per_action"),
                (k % 2).cast("int").alias("push_opt_in"),
                ((k + 1) % 3 != 0).cast("int").alias("email_opt_in"),
                F.when(k % 2 == 0, 1).otherwise(0).alias("is_treatment"),
            ))
