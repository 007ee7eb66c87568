"""Readers, writers and projections of the input tables.

Scans select only the needed columns so Catalyst prunes the Parquet read; filters are
plain column predicates so they reach the scan as ``PushedFilters``. Output paths on a
cluster must be shared storage; the helpers never pick a machine-local folder.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("persona", T.StringType()),
    T.StructField("signup_date", T.StringType()), T.StructField("treatment_group", T.StringType()),
    T.StructField("churn_label", T.IntegerType())])
EVENT_COLUMNS = ("customer_id", "event_type", "event_date", "timestamp", "amount", "session_duration",
                 "marketing_channel", "marketing_response")
DATE_ALIASES = ("event_date", "timestamp", "event_timestamp", "date")
TYPE_ALIASES = ("event_type", "event_name", "type", "activity", "event")


def _read_any(spark: SparkSession, base: str) -> DataFrame:
    """Parquet preferred over CSV, on any file system that Spark reads."""
    if base.endswith(".csv"):
        return spark.read.option("header", True).csv(base)
    try:
        return spark.read.parquet(base if base.endswith(".parquet") else base + ".parquet")
    except AnalysisException as e:
        if base.endswith(".parquet") or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.option("header", True).csv(base + ".csv")


def load_customers(spark: SparkSession, base: str) -> DataFrame:
    """Customers with ``signup_date`` parsed (bad values -> null)."""
    df = _read_any(spark, base)
    if "signup_date" in df.columns:
        df = df.withColumn("signup_date", F.to_date(F.try_to_timestamp(F.col("signup_date").cast("string"))))
    return df


def load_events(spark: SparkSession, base: str) -> DataFrame:
    """Only the 8 event columns that exist, dates parsed, numbers coerced (bad -> null)."""
    df = _read_any(spark, base)
    cols = [c for c in EVENT_COLUMNS if c in df.columns]
    df = df.select(*cols)
    if "event_date" in df.columns:
        df = df.withColumn("event_date", F.to_date(F.try_to_timestamp(F.col("event_date").cast("string"))))
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp").cast("string")))
    for c in ("amount", "session_duration"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("string").try_cast("double"))
    return df


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, date_cols=()) -> DataFrame:
    """S3: CSV with an explicit schema (no inference) and date parsing."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    for c in date_cols:
        df = df.withColumn(c, F.to_date(F.try_to_timestamp(F.col(c))))
    return df


def normalize_events(events: DataFrame) -> DataFrame:
    """Resolve date / type aliases from the schema at plan time; non-``event_date``
    sources are truncated to the day. Fails naming the missing columns."""
    cols = {}
    if "customer_id" in events.columns:
        cols["customer_id"] = F.col("customer_id")
    src = next((c for c in DATE_ALIASES if c in events.columns), None)
    if src is not None:
        d = F.col(src)
        cols["event_date"] = d.cast("date") if src == "event_date" else F.to_date(d.cast("timestamp"))
    tsrc = next((c for c in TYPE_ALIASES if c in events.columns), None)
    if tsrc is not None:
        cols["event_type"] = F.col(tsrc).cast("string")
    missing = {"customer_id", "event_date", "event_type"} - set(cols)
    if missing:
        raise KeyError("Event data missing required cohort columns: " + ", ".join(sorted(missing)))
    return events.select(*[v.alias(k) for k, v in cols.items()])


def prepare_events(events: DataFrame) -> DataFrame:
    """Keep 7 feature columns, ``event_timestamp`` -> ``timestamp`` fallback, coerce."""
    e = events
    if "timestamp" not in e.columns and "event_timestamp" in e.columns:
        e = e.withColumnRenamed("event_timestamp", "timestamp")
    keep = [c for c in ("customer_id", "event_type", "event_date", "timestamp", "amount", "session_duration")
            if c in e.columns]
    e = e.select(*keep)
    if "event_date" in e.columns:
        e = e.withColumn("event_date", F.col("event_date").cast("date"))
    for c in ("amount", "session_duration"):
        if c in e.columns:
            e = e.withColumn(c, F.col(c).cast("double"))
    return e


def save_feature_store(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S6 write: overwrite Parquet (or CSV)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def load_feature_store(spark: SparkSession, path: str) -> DataFrame:
    """S6 read: Parquet, or CSV if the files are no Parquet; an error names a path that is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no feature store at {path}") from e
    except Py4JJavaError as e:
        if "CANNOT_READ_FILE_FOOTER" not in str(e):
            raise
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def save_result(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write one result table (Parquet or JSON lines)."""
    w = df.write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.parquet(path))
    return path


def cohort_purchases(events: DataFrame, default_segment: str = "all") -> DataFrame:
    """Purchases with amount > 0 renamed to ``revenue``, default segment."""
    e = events.filter(F.col("amount") > 0)
    seg = F.col("segment") if "segment" in e.columns else F.lit(default_segment)
    return e.select("customer_id", "event_date", F.col("amount").alias("revenue"), seg.alias("segment"))


def observation_cutoff(end_date, no_purchase_days: int = 30, no_login_days: int = 60):
    """S9 cutoff: T = end - max(no_purchase, no_login) days (a Column if end is a Column)."""
    days = max(no_purchase_days, no_login_days)
    if isinstance(end_date, str):
        end_date = F.to_date(F.lit(end_date))
    return F.date_sub(end_date, days)


def filter_to_cutoff(events: DataFrame, cutoff) -> DataFrame:
    """Keep ``event_date <= T`` (pushed to the scan when T is a literal)."""
    t = F.to_date(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    return events.filter(F.col("event_date") <= t)


def filter_offers(offers: DataFrame, risks=None, segments=None, types=None) -> DataFrame:
    """Multi-select filter on risk level, segment and offer type; priority order."""
    out = offers
    if risks:
        out = out.filter(F.col("risk_level").isin(*risks))
    if segments:
        out = out.filter(F.col("segment").isin(*segments))
    if types:
        out = out.filter(F.col("offer_type").isin(*types))
    return out.orderBy(F.desc("priority_score"), F.asc("customer_id"))
