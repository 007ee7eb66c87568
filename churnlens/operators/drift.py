"""Drift and performance monitoring.

All features are handled in one job: the frames are unpivoted to long form
``(feature, value)`` and every step groups by feature. Bin edges are a tiny
``(feature, edges array)`` table joined by broadcast; the bucket of a value is the
number of edges <= value (numpy ``histogram`` semantics, last bin closed). KS uses
the distinct-value aggregate and a per-feature prefix sum, never a sort of raw rows
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.config import DriftParams
from churnlens.functions import special as sf
from churnlens.functions.prefix import global_order
from churnlens.functions.quantiles import quantiles_from_counts, value_counts
from churnlens.session import cut_lineage

LEVEL_RANK = {"green": 0, "ok": 0, "yellow": 1, "warning": 1, "red": 2, "drift": 2, "degraded": 2}


def long_form(df: DataFrame, features: list[str], cast: str = "double") -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in features])).alias("x")) \
        .select("x.feature", "x.value")


# ------------------------------------------------------------------ D1-D4

def bin_edges(ref: DataFrame, features: list[str], n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """``(feature, edges)``: quantile edges widened by 1e-10 at both ends, de-duplicated;
    fewer than n+1 distinct edges -> equal width over [min - 1e-10, max + 1e-10]."""
    if strategy == "equal_width":
        long = long_form(ref, features).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        mm = long.groupBy("feature").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
        return mm.select("feature", _even_edges(F.col("vmin"), F.col("vmax"), n_bins).alias("edges"))
    return edges_of_counts(value_counts(long_form(ref, features), "value", ["feature"]), n_bins)


def _even_edges(a: Column, b: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.when(i == n, b).otherwise(a + i * ((b - a) / n)))


def edges_of_counts(counts: DataFrame, n: int) -> DataFrame:
    """Quantile edges from a materialised table (feature, __v, __c) of distinct values and their counts."""
    mm = counts.groupBy("feature").agg(F.min("__v").alias("vmin"), F.max("__v").alias("vmax"))
    q = quantiles_from_counts(counts, [i / n for i in range(n + 1)], ["feature"])
    qa = q.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("q_index", "q"))).alias("__s"))
    j = qa.join(mm, "feature")
    raw = F.transform("__s", lambda x: x["q"])
    last = F.size(raw) - 1
    adj = F.transform(raw, lambda e, i: F.when(i == 0, F.least(e, F.col("vmin")) - 1e-10)
                      .when(i == last, F.greatest(e, F.col("vmax")) + 1e-10).otherwise(e))
    uniq = F.array_sort(F.array_distinct(adj))
    fallback = _even_edges(F.col("vmin") - 1e-10, F.col("vmax") + 1e-10, n)
    return j.select("feature", F.when(F.size(uniq) < n + 1, fallback).otherwise(uniq).alias("edges"))


def _bucket(value: Column, edges: list[float]) -> Column:
    """numpy histogram bin index for literal sorted ``edges``; null outside them.

    bin = number of inner edges <= value (the last bin is closed), written as plain
    comparisons so that it stays inside whole-stage codegen."""
    nb = len(edges) - 1
    k = F.lit(0)
    for x in edges[1:nb]:
        k = k + F.when(value >= F.lit(x), 1).otherwise(0)
    return F.when((value < F.lit(edges[0])) | (value > F.lit(edges[-1])), F.lit(None)).otherwise(k)


def _bucket_by_feature(feature: Column, value: Column, rows) -> Column:
    expr = None
    for r in rows:
        b = _bucket(value, [float(x) for x in r["edges"]])
        expr = F.when(feature == r["feature"], b) if expr is None else expr.when(feature == r["feature"], b)
    return expr if expr is not None else F.lit(None).cast("int")


def psi(ref: DataFrame, prod: DataFrame, features: list[str], p: DriftParams = DriftParams(),
        edges: DataFrame | None = None) -> DataFrame:
    """PSI per feature = sum((p - r) * ln(p / r)) over bins, shares clipped at epsilon
    and renormalised. A production window without a value inside the edges (all null, or wholly
    outside them) has a share of epsilon in every bin; a feature whose reference has no value has
    no edges and no row.

    The edges (features x bins, bounded by parameters) are collected once and written into
    the bin expression."""
    both = (long_form(ref, features).withColumn("side", F.lit("r"))
            .unionByName(long_form(prod, features).withColumn("side", F.lit("p")))
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    # Both windows are read once, into distinct values with their counts; edges and bins come from these.
    values = cut_lineage(both.groupBy("feature", F.col("value").alias("__v")).agg(
        F.count_if(F.col("side") == "r").alias("rc"), F.count_if(F.col("side") == "p").alias("pc")))
    if edges is None:
        edges = edges_of_counts(values.filter("rc > 0").select("feature", "__v", F.col("rc").alias("__c")), p.n_bins)
    rows = edges.collect()          # features x bins
    cnt = with_bin(values.withColumnRenamed("__v", "value"), rows).groupBy("feature", "bin").agg(
        F.sum("rc").alias("rc"), F.sum("pc").alias("pc"))
    return psi_of_counts(bin_grid(ref.sparkSession, rows).join(cnt, ["feature", "bin"], "left"), p)


def with_bin(long: DataFrame, rows) -> DataFrame:
    """The values of a long table that lie inside the edges (rows of ``bin_edges``), with their ``bin``."""
    known = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.withColumn("bin", _bucket_by_feature(F.col("feature"), F.col("value"), rows)).filter(F.col("bin").isNotNull())


def bin_grid(spark: SparkSession, rows) -> DataFrame:
    """(feature, bin) for all bins of the edges."""
    cells = [(r["feature"], b) for r in rows for b in range(len(r["edges"]) - 1)]
    return spark.createDataFrame(cells, "feature string, bin int")


def psi_of_counts(counts: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """PSI per feature from the counts ``rc`` and ``pc`` (null counts as 0) of all its bins."""
    d = counts.na.fill(0, ["rc", "pc"])
    tot = d.groupBy("feature").agg(F.sum("rc").alias("rt"), F.sum("pc").alias("pt"))
    d = d.join(tot, "feature")
    share = lambda c, t: F.greatest(F.coalesce(F.try_divide(c, t), F.lit(0.0)), F.lit(p.epsilon))
    d = d.withColumn("r", share("rc", "rt")).withColumn("q", share("pc", "pt"))
    norm = d.groupBy("feature").agg(F.sum("r").alias("rs"), F.sum("q").alias("qs"))
    d = d.join(norm, "feature").withColumn("r", F.col("r") / F.col("rs")).withColumn("q", F.col("q") / F.col("qs"))
    return d.groupBy("feature").agg(F.sum((F.col("q") - F.col("r")) * F.log(F.col("q") / F.col("r"))).alias("psi"))


def psi_level(c: Column, p: DriftParams = DriftParams()) -> Column:
    return F.when(c >= p.psi_red, "red").when(c >= p.psi_yellow, "yellow").otherwise("green")


def psi_report(ref: DataFrame, prod: DataFrame, features: list[str], p: DriftParams = DriftParams()) -> DataFrame:
    """D3: PSI, alert level (green < .10 <= yellow < .25 <= red), drifted = red."""
    out = psi(ref, prod, features, p)
    return out.withColumn("level", psi_level(F.col("psi"), p)).withColumn("is_drifted", F.col("level") == "red")


def psi_summary(report: DataFrame) -> DataFrame:
    """Counts per level, worst feature, drifted names."""
    return report.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("level") == "green").alias("n_green"),
        F.count_if(F.col("level") == "yellow").alias("n_yellow"), F.count_if(F.col("level") == "red").alias("n_red"),
        F.max_by("feature", F.struct("psi", "feature")).alias("worst_feature"), F.max("psi").alias("max_psi"),
        F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature")))).alias("drifted_features"))


# ------------------------------------------------------------------ D5-D8

def ks_two_sample(ref: DataFrame, prod: DataFrame, features: list[str], with_p: bool = True) -> DataFrame:
    """KS statistic = max |F_ref - F_prod| over distinct values, per feature; the p-value is exact up
    to 10,000 rows a side. A feature without a value on a side has an undefined (null) statistic."""
    out = ks_by_feature(long_form(ref, features), long_form(prod, features), with_p, len(features))
    names = ref.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    out = names.join(out, "feature", "left")        # one row a feature
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_ref", "n_prod")})


def ks_by_feature(ref: DataFrame, prod: DataFrame, with_p: bool = True, n_parts: int | None = None) -> DataFrame:
    """The KS test of two long tables (feature, value), for any number of features. Their p-values are dealt
    over ``n_parts`` tasks (default: the shuffle partitions)."""
    both = (ref.withColumn("side", F.lit("r")).unionByName(prod.withColumn("side", F.lit("p")))
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    v = both.groupBy("feature", "value").agg(F.count_if(F.col("side") == "r").alias("rc"),
                                             F.count_if(F.col("side") == "p").alias("pc"))
    o = global_order(v, [("value", True)], partition_by=["feature"], sums={"cr": "rc", "cp": "pc"},
                     totals={"n_ref": "cr", "n_prod": "cp"}, rank_col=None)
    gap = F.abs(F.try_divide("cr", "n_ref") - F.try_divide("cp", "n_prod"))
    out = o.groupBy("feature").agg(F.max(gap).alias("ks_statistic"), F.max("n_ref").cast("long").alias("n_ref"),
                                   F.max("n_prod").cast("long").alias("n_prod"))
    if with_p:
        # A row a feature is little data, which AQE would give to one task, but exact p-values take their time.
        n_parts = n_parts or int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartition(n_parts)
        out = out.withColumn("p_value", sf.ks_pvalue_udf(F.col("ks_statistic"), F.col("n_ref"), F.col("n_prod")))
    return out


def chi_square_drift(ref: DataFrame, prod: DataFrame, features: list[str], with_p: bool = True) -> DataFrame:
    """Production counts vs reference shares over the union of categories; undefined (null) for a
    feature without a value on a side."""
    both = (long_form(ref, features, "string").withColumn("side", F.lit("r"))
            .unionByName(long_form(prod, features, "string").withColumn("side", F.lit("p")))
            .filter(F.col("value").isNotNull()))
    c = both.groupBy("feature", "value").agg(F.count_if(F.col("side") == "r").alias("rc"),
                                             F.count_if(F.col("side") == "p").alias("pc"))
    t = c.groupBy("feature").agg(F.sum("rc").alias("rt"), F.sum("pc").alias("pt"), F.count(F.lit(1)).alias("k"))
    j = c.join(t, "feature")
    exp = F.greatest(F.try_divide("rc", "rt") * F.col("pt"), F.lit(1e-10))
    term = F.when((F.col("rt") > 0) & (F.col("pt") > 0), F.pow(F.col("pc") - exp, 2) / exp)
    out = j.groupBy("feature").agg(F.sum(term).alias("chi2_statistic"),
                                   F.first("k").alias("n_categories"))
    names = ref.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    out = names.join(out, "feature", "left").withColumn("n_categories", F.coalesce("n_categories", F.lit(0).cast("long")))
    if with_p:
        out = out.withColumn("p_value", sf.chi2_sf_udf(F.col("chi2_statistic"), (F.col("n_categories") - 1).cast("double")))
    return out


def ks_report(ref: DataFrame, prod: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """Numeric columns -> KS, string columns -> chi-square; drift p <= .01, warning <= .05,
    ``undefined`` without a statistic (a window without a value)."""
    num = [f.name for f in ref.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    cat = [f.name for f in ref.schema.fields if f.dataType.typeName() == "string"]
    parts = []
    if num:
        parts.append(ks_two_sample(ref, prod, num).select("feature", F.lit("ks").alias("test_type"),
                                                          F.col("ks_statistic").alias("statistic"), "p_value"))
    if cat:
        parts.append(chi_square_drift(ref, prod, cat).select("feature", F.lit("chi2").alias("test_type"),
                                                             F.col("chi2_statistic").alias("statistic"), "p_value"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    lvl = F.when(F.col("p_value") <= p.ks_drift_p, "drift").when(F.col("p_value") <= p.ks_warning_p, "warning") \
        .when(F.col("statistic").isNull(), "undefined").otherwise("ok")
    return out.withColumn("level", lvl)


def ks_summary(report: DataFrame) -> DataFrame:
    """Counts by level and by test type."""
    return report.groupBy("test_type").agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("level") == "drift").alias("n_drift"),
        F.count_if(F.col("level") == "warning").alias("n_warning"), F.count_if(F.col("level") == "ok").alias("n_ok"))


# ------------------------------------------------------------------ D9-D13

def performance_alerts(history: DataFrame, metrics: dict[str, float], strategy: str = "best",
                       model_col: str = "model", ts_col: str = "timestamp") -> DataFrame:
    """Per model and metric, latest value vs the best (or first) earlier value;
    degraded when the drop >= threshold, warning when >= half of it."""
    long = history.select(model_col, ts_col, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold"))
        for m, t in metrics.items()])).alias("x")).select(model_col, ts_col, "x.*")
    last_ts = history.groupBy(model_col).agg(F.max(ts_col).alias("__last"))
    j = long.join(last_ts, model_col)
    cur = j.filter(F.col(ts_col) == F.col("__last")).groupBy(model_col, "metric", "threshold") \
        .agg(F.max("value").alias("current"))
    prev = j.filter((F.col(ts_col) < F.col("__last")) & F.col("value").isNotNull())
    if strategy == "first":
        base = prev.groupBy(model_col, "metric").agg(F.min_by("value", ts_col).alias("baseline"),
                                                     F.min(ts_col).alias("baseline_timestamp"))
    else:
        base = prev.groupBy(model_col, "metric").agg(
            F.max("value").alias("baseline"),
            F.min_by(ts_col, F.struct(-F.col("value"), F.col(ts_col))).alias("baseline_timestamp"))
    out = cur.join(base, [model_col, "metric"], "left")
    drop = F.greatest(F.lit(0.0), F.col("baseline") - F.col("current"))
    status = (F.when(F.col("baseline").isNull(), "insufficient_history")
              .when(drop >= F.col("threshold"), "degraded")
              .when((drop >= F.col("threshold") * 0.5) & (drop > 0), "warning").otherwise("ok"))
    return out.withColumn("drop", F.when(F.col("baseline").isNotNull(), drop)).withColumn("status", status)


def monitor(psi_rep: DataFrame, ks_rep: DataFrame, perf: DataFrame) -> DataFrame:
    """Overall level (green, yellow, red) = worst of the PSI, KS and performance levels; the
    drifted features are those of red PSI or drifted KS only."""
    rank = F.create_map(*[x for k, v in LEVEL_RANK.items() for x in (F.lit(k), F.lit(v))])
    u = (psi_rep.select(F.lit("psi").alias("source"), "feature", "level")
         .unionByName(ks_rep.select(F.lit("ks").alias("source"), "feature", "level"))
         .unionByName(perf.select(F.lit("performance").alias("source"),
                                  F.concat_ws(":", "model", "metric").alias("feature"), F.col("status").alias("level"))))
    u = u.withColumn("rank", F.coalesce(rank[F.col("level")], F.lit(0)))
    names = ["green", "yellow", "red"]
    drifted = F.when((F.col("rank") >= 2) & (F.col("source") != "performance"), F.col("feature"))
    return u.agg(F.max("rank").alias("max_rank"),
                 F.array_sort(F.collect_set(drifted)).alias("drifted_features"),
                 F.count_if(F.col("rank") >= 2).alias("n_alerts")) \
        .withColumn("overall_alert_level", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("max_rank") + 1))


def drift_history_rows(psi_rep: DataFrame, ks_num: DataFrame, ts, p: DriftParams = DriftParams(),
                       initial: bool = True) -> DataFrame:
    """One row per feature (PSI full-outer KS) plus an ``__overall__`` row of the means.

    Red needs a red PSI; a yellow PSI, or KS drift alone, is yellow. The overall level follows the
    mean PSI. A missing PSI or KS statistic counts as 0; values have 6 digits."""
    j = psi_rep.select("feature", "psi").join(
        ks_num.select("feature", F.col("ks_statistic").alias("ks_stat"), F.col("p_value").alias("ks_pvalue")),
        "feature", "full")
    j = j.withColumn("psi", F.coalesce("psi", F.lit(0.0))).withColumn("ks_stat", F.coalesce("ks_stat", F.lit(0.0)))
    level = lambda x: F.when(x >= p.psi_red, "red").when(x >= p.psi_yellow, "yellow")
    ks_drift = F.coalesce(F.col("ks_pvalue") <= p.ks_drift_p, F.lit(False))
    rows = j.withColumn("alert_level", F.coalesce(level(F.col("psi")), F.when(ks_drift, "yellow").otherwise("green")))
    stats = rows.agg(F.count_if((F.col("alert_level") == "red") | ks_drift).alias("num_drifted_features"),
                     F.coalesce(F.avg("psi"), F.lit(0.0)).alias("psi_mean"),
                     F.coalesce(F.avg("ks_stat"), F.lit(0.0)).alias("ks_mean"))
    overall = stats.select(F.lit("__overall__").alias("feature_name"), F.col("psi_mean").alias("psi"),
                           F.col("ks_mean").alias("ks_stat"), F.lit(None).cast("double").alias("ks_pvalue"),
                           F.coalesce(level(F.col("psi_mean")), F.lit("green")).alias("alert_level"))
    per = rows.select(F.col("feature").alias("feature_name"), "psi", "ks_stat", "ks_pvalue", "alert_level")
    out = per.unionByName(overall).crossJoin(F.broadcast(stats))
    out = out.withColumns({c: F.round(c, 6) for c in ("psi", "ks_stat", "ks_pvalue")})
    tsv = ts if isinstance(ts, Column) else F.lit(ts)
    return (out.withColumn("timestamp", tsv).withColumn("psi_yellow_threshold", F.lit(p.psi_yellow))
            .withColumn("psi_red_threshold", F.lit(p.psi_red)).withColumn("ks_pvalue_threshold", F.lit(p.ks_drift_p))
            .withColumn("is_initial_check", F.lit(initial)))


def trend_guard(df: DataFrame, ts_col: str, min_points: int = 5, min_span_s: float = 5.0,
                min_span_h: float = 1.0) -> DataFrame:
    """Enough points and time span to draw a trend."""
    t = F.col(ts_col).cast("timestamp")
    s = df.agg(F.count(t).alias("n_points"),
               (F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))).alias("__us"))
    span = F.coalesce(F.col("__us") / 1e6, F.lit(0.0))
    return s.select("n_points", span.alias("span_seconds"),
                    ((F.col("n_points") >= min_points) & (span >= min_span_s) & (span >= min_span_h * 3600))
                    .alias("trend_ok"))


def merge_histories(*histories: DataFrame, keys=("timestamp", "model")) -> DataFrame:
    """Full outer join of metric histories on (timestamp, model)."""
    out = histories[0]
    for h in histories[1:]:
        out = out.join(h, list(keys), "full")
    return out
