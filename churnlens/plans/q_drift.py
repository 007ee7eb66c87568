"""Queries: drift and monitoring (D1-D13). Reference = lineitem shipped before the split
date, production = shipped on or after it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlens.config import DriftParams
from churnlens.operators import drift as dr
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.functions import sketches as sk
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources import tables as tb
from churnlens.streaming import drift as sd

SPLIT = "1998-07-01"
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]
P = DriftParams()
PERF = {"accuracy": 0.03, "precision": 0.05, "recall": 0.05}


def _split(spark, sf, cols):
    li = tb.read_table(spark, sf, "lineitem")
    ref = li.filter(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")).select(*cols)
    prod = li.filter(F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz")).select(*cols)
    return ref, prod


def _long_sql(side: str, cols: list[str], cast: str = "DOUBLE") -> str:
    op = "<" if side == "r" else ">="
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS {cast}) AS value FROM lineitem WHERE l_shipdate {op} TIMESTAMP '{SPLIT}'"
        for c in cols)


N = P.n_bins
PROBS = "[" + ", ".join(repr(i / N) for i in range(N + 1)) + "]"
LIN = "list_transform(range(0, {n1}), lambda i: CASE WHEN i = {n} THEN {b} ELSE {a} + i * (({b} - {a}) / {n}) END)"
EDGES = f"""rlong AS ({_long_sql('r', NUM)}),
plong AS ({_long_sql('p', NUM)}),
e0 AS (SELECT feature, quantile_cont(value, {PROBS}) AS qs, min(value) AS vmin, max(value) AS vmax
  FROM rlong WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature),
e1 AS (SELECT feature, vmin, vmax, list_sort(list_distinct(list_transform(qs, lambda e, i:
    CASE WHEN i = 1 THEN least(e, vmin) - 1e-10 WHEN i = {N + 1} THEN greatest(e, vmax) + 1e-10 ELSE e END))) AS u
  FROM e0),
edges AS (SELECT feature, CASE WHEN len(u) < {N + 1}
    THEN {LIN.format(n1=N + 1, n=N, a='(vmin - 1e-10)', b='(vmax + 1e-10)')} ELSE u END AS edges FROM e1)"""
PSI = EDGES + f""",
bth AS (SELECT feature, value, 'r' AS side FROM rlong UNION ALL SELECT feature, value, 'p' FROM plong),
binned AS (SELECT b.feature, b.side,
    CASE WHEN b.value < e.edges[1] OR b.value > e.edges[-1] THEN NULL
         WHEN len(list_filter(e.edges, lambda x: x <= b.value)) - 1 >= len(e.edges) - 1 THEN len(e.edges) - 2
         ELSE len(list_filter(e.edges, lambda x: x <= b.value)) - 1 END AS bin
  FROM bth b JOIN edges e ON b.feature = e.feature WHERE b.value IS NOT NULL AND NOT isnan(b.value)),
cnt AS (SELECT feature, bin, count_if(side = 'r') AS rc, count_if(side = 'p') AS pc FROM binned
  WHERE bin IS NOT NULL GROUP BY feature, bin),
grid AS (SELECT feature, unnest(range(0, len(edges) - 1)) AS bin FROM edges),
d0 AS (SELECT g.feature, g.bin, coalesce(c.rc, 0) AS rc, coalesce(c.pc, 0) AS pc FROM grid g
  LEFT JOIN cnt c ON g.feature = c.feature AND g.bin = c.bin),
d1 AS (SELECT *, greatest(rc / sum(rc) OVER (PARTITION BY feature), {P.epsilon!r}) AS r,
    greatest(pc / sum(pc) OVER (PARTITION BY feature), {P.epsilon!r}) AS q FROM d0),
d2 AS (SELECT *, r / sum(r) OVER (PARTITION BY feature) AS rn, q / sum(q) OVER (PARTITION BY feature) AS qn FROM d1),
psi AS (SELECT feature, sum((qn - rn) * ln(qn / rn)) AS psi FROM d2 GROUP BY feature),
prep AS (SELECT feature, psi, CASE WHEN psi >= {P.psi_red} THEN 'red' WHEN psi >= {P.psi_yellow} THEN 'yellow'
    ELSE 'green' END AS level, psi >= {P.psi_red} AS is_drifted FROM psi)"""


@register("bin_edges", oracle("SELECT feature, list_transform(edges, lambda x: (round(x, 6) + 0.0)) AS edges FROM edges",
                              views=[], ctes=[EDGES]))
def q_bin_edges(spark, sf):
    """Quantile bin edges per feature of the reference window."""
    ref, _ = _split(spark, sf, NUM)
    return dr.bin_edges(ref, NUM, P.n_bins)


@register("psi", oracle("SELECT * FROM psi", views=[], ctes=[PSI], doubles=["psi"]))
def q_psi(spark, sf):
    """Population stability index per feature."""
    ref, prod = _split(spark, sf, NUM)
    return dr.psi(ref, prod, NUM, P)


@register("psi_report", oracle("SELECT * FROM prep", views=[], ctes=[PSI], doubles=["psi"]))
def q_psi_report(spark, sf):
    """D3: PSI with alert levels."""
    ref, prod = _split(spark, sf, NUM)
    return dr.psi_report(ref, prod, NUM, P)


@register("psi_summary", oracle("""
SELECT count(*) AS n_features, count_if(level = 'green') AS n_green, count_if(level = 'yellow') AS n_yellow,
  count_if(level = 'red') AS n_red, first(feature ORDER BY psi DESC, feature DESC) AS worst_feature,
  max(psi) AS max_psi, list_sort(coalesce(list(feature) FILTER (WHERE is_drifted), []::VARCHAR[])) AS drifted_features
FROM prep""", views=[], ctes=[PSI], doubles=["max_psi"]))
def q_psi_summary(spark, sf):
    """PSI summary."""
    ref, prod = _split(spark, sf, NUM)
    return dr.psi_summary(dr.psi_report(ref, prod, NUM, P))


KS = f"""rlong AS ({_long_sql('r', NUM)}),
plong AS ({_long_sql('p', NUM)}),
kv AS (SELECT feature, value, count_if(side = 'r') AS rc, count_if(side = 'p') AS pc FROM (
    SELECT feature, value, 'r' AS side FROM rlong UNION ALL SELECT feature, value, 'p' FROM plong)
  WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature, value),
kc AS (SELECT *, sum(rc) OVER w AS cr, sum(pc) OVER w AS cp, sum(rc) OVER (PARTITION BY feature) AS n_ref,
    sum(pc) OVER (PARTITION BY feature) AS n_prod FROM kv
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT feature, max(abs(cr / n_ref - cp / n_prod)) AS ks_statistic, CAST(any_value(n_ref) AS BIGINT) AS n_ref,
    CAST(any_value(n_prod) AS BIGINT) AS n_prod FROM kc GROUP BY feature)"""


#: The same after other CTEs that have the two windows.
KS_TAIL = KS[KS.index("kv AS"):]


@register("ks_statistic", oracle("SELECT * FROM ks", views=[], ctes=[KS], doubles=["ks_statistic"]))
def q_ks_statistic(spark, sf):
    """Two-sample KS statistic per numeric feature."""
    ref, prod = _split(spark, sf, NUM)
    return dr.ks_two_sample(ref, prod, NUM, with_p=False)


def ks_p_sql(tests: str) -> str:
    """CTEs ``walk`` and ``pv`` (k, p_value) for a table of tests (k, n1, n2, top), top = D * n1 * n2.

    Up to 10,000 rows a side a recursive query takes the steps of the exact p-value (a place y of the second
    sample's values, x = t - y of the first's), beyond it the Kolmogorov series holds."""
    return f"""walk(k, n1, n2, top, t, p) AS (
  SELECT k, n1, n2, top, 0, [1.0::DOUBLE] || [0.0::DOUBLE for y in range(n2)] FROM {tests}
  WHERE n1 > 0 AND n2 > 0 AND top > 0 AND greatest(n1, n2) <= 10000
  UNION ALL SELECT k, n1, n2, top, t + 1, [CASE WHEN abs((t + 1 - y) * n2 - y * n1) >= top OR t + 1 - y < 0 OR t + 1 - y > n1 THEN 0.0 ELSE
      p[y + 1] * greatest(n1 - t + y, 0) / (n1 + n2 - t) + CASE WHEN y > 0 THEN p[y] * (n2 - y + 1) / (n1 + n2 - t) ELSE 0.0 END END
      for y in range(n2 + 1)]
  FROM walk WHERE t < n1 + n2),
kx AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)::DOUBLE) * top / (n1::DOUBLE * n2) AS x FROM {tests} WHERE n1 > 0 AND n2 > 0),
pv AS (SELECT kx.k, CASE WHEN kx.top = 0 THEN 1.0 WHEN w.p IS NOT NULL THEN 1.0 - w.p[kx.n2 + 1] WHEN x < 0.2 THEN 1.0
    ELSE least(1.0, greatest(0.0, 2 * list_sum([CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * x * x) for i in range(1, 101)]))) END
    AS p_value FROM kx LEFT JOIN walk w ON w.k = kx.k AND w.t = kx.n1 + kx.n2)"""


#: Per supplier the quantities before and from the split on.
KS_SUPPLIER = f"""sv AS (SELECT l_suppkey AS k, l_quantity AS value, l_shipdate < TIMESTAMP '{SPLIT}' AS early FROM lineitem
  WHERE l_quantity IS NOT NULL AND NOT isnan(l_quantity) AND l_shipdate IS NOT NULL),
sc AS (SELECT k, value, count_if(early) AS rc, count_if(NOT early) AS pc FROM sv GROUP BY k, value),
sw AS (SELECT *, sum(rc) OVER w AS cr, sum(pc) OVER w AS cp, sum(rc) OVER (PARTITION BY k) AS n1, sum(pc) OVER (PARTITION BY k) AS n2
  FROM sc WINDOW w AS (PARTITION BY k ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sd AS (SELECT k, any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2, max(abs(cr * n2 - cp * n1))::BIGINT AS top FROM sw GROUP BY k),
{ks_p_sql("sd")}"""


@register("ks_by_supplier", f"""WITH RECURSIVE {KS_SUPPLIER}
SELECT CAST(sd.k AS VARCHAR) AS feature, round(CASE WHEN n1 > 0 AND n2 > 0 THEN top / (n1 * n2)::DOUBLE END, 6) + 0.0 AS ks_statistic,
  n1 AS n_ref, n2 AS n_prod, round(p_value, 6) + 0.0 AS p_value FROM sd LEFT JOIN pv ON sd.k = pv.k""")
def q_ks_by_supplier(spark, sf):
    """Exact two-sample KS test of each supplier's quantities, earlier against later shipments."""
    li = tb.read_table(spark, sf, "lineitem").filter("l_shipdate IS NOT NULL").select(
        F.col("l_suppkey").cast("string").alias("feature"), F.col("l_quantity").cast("double").alias("value"), "l_shipdate")
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")
    return dr.ks_by_feature(li.filter(early).drop("l_shipdate"), li.filter(~early).drop("l_shipdate"))


@register("chi_square_drift", oracle(f"""
SELECT feature, sum(pow(pc - greatest(rc / rt * pt, 1e-10), 2) / greatest(rc / rt * pt, 1e-10)) AS chi2_statistic,
  any_value(k) AS n_categories
FROM (SELECT *, sum(rc) OVER (PARTITION BY feature) AS rt, sum(pc) OVER (PARTITION BY feature) AS pt,
        count(*) OVER (PARTITION BY feature) AS k FROM (
  SELECT feature, value, count_if(side = 'r') AS rc, count_if(side = 'p') AS pc FROM (
    SELECT feature, value, 'r' AS side FROM ({_long_sql('r', CAT, 'VARCHAR')})
    UNION ALL SELECT feature, value, 'p' FROM ({_long_sql('p', CAT, 'VARCHAR')}))
  WHERE value IS NOT NULL GROUP BY feature, value))
GROUP BY feature""", views=[], doubles=["chi2_statistic"]))
def q_chi_square_drift(spark, sf):
    """Chi-square drift statistic for categorical features."""
    ref, prod = _split(spark, sf, CAT)
    return dr.chi_square_drift(ref, prod, CAT, with_p=False)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


KS_P = f"""kt AS (SELECT feature AS k, any_value(n_ref)::BIGINT AS n1, any_value(n_prod)::BIGINT AS n2,
    max(abs(cr * n_prod - cp * n_ref))::BIGINT AS top FROM kc GROUP BY feature),
{ks_p_sql("kt")},
ksp AS (SELECT ks.feature, ks.ks_statistic, pv.p_value FROM ks LEFT JOIN pv ON pv.k = ks.feature)"""
#: Upper tail of chi-square with d degrees of freedom: the series of the lower incomplete gamma function.
CHI = f"""ct AS (SELECT feature, value, count_if(side = 'r') AS rc, count_if(side = 'p') AS pc FROM (
    SELECT feature, value, 'r' AS side FROM ({_long_sql('r', CAT, 'VARCHAR')})
    UNION ALL SELECT feature, value, 'p' FROM ({_long_sql('p', CAT, 'VARCHAR')})) WHERE value IS NOT NULL GROUP BY feature, value),
ce AS (SELECT *, sum(rc) OVER (PARTITION BY feature) AS rt, sum(pc) OVER (PARTITION BY feature) AS pt FROM ct),
chi AS (SELECT feature, sum(CASE WHEN rt > 0 AND pt > 0 THEN pow(pc - greatest(rc / rt * pt, 1e-10), 2) / greatest(rc / rt * pt, 1e-10) END)
    AS chi2_statistic, count(*) - 1 AS d FROM ce GROUP BY feature),
chp AS (SELECT feature, chi2_statistic, CASE WHEN d < 1 OR chi2_statistic IS NULL THEN NULL WHEN chi2_statistic <= 0 THEN 1.0
    WHEN chi2_statistic > 1400 THEN 0.0 ELSE greatest(0.0, 1 - list_sum([exp(-chi2_statistic / 2 + (d / 2.0 + i) * ln(chi2_statistic / 2)
      - lgamma(d / 2.0 + i + 1)) for i in range(0, 3000)])) END AS p_value FROM chi)"""
KS_REPORT = f"""krep AS (SELECT *, CASE WHEN p_value <= {P.ks_drift_p} THEN 'drift' WHEN p_value <= {P.ks_warning_p} THEN 'warning'
    WHEN statistic IS NULL THEN 'undefined' ELSE 'ok' END AS level FROM (
  SELECT feature, 'ks' AS test_type, ks_statistic AS statistic, p_value FROM ksp
  UNION ALL SELECT feature, 'chi2', chi2_statistic, p_value FROM chp))"""


@register("ks_report", _recursive(oracle("SELECT * FROM krep", views=[], ctes=[KS, KS_P, CHI, KS_REPORT], doubles=["statistic", "p_value"])))
def q_ks_report(spark, sf):
    """KS / chi-square report with p-value levels."""
    ref, prod = _split(spark, sf, NUM + CAT)
    return dr.ks_report(ref, prod, P)


@register("ks_summary", _recursive(oracle("""SELECT test_type, count(*) AS n_features, count_if(level = 'drift') AS n_drift,
  count_if(level = 'warning') AS n_warning, count_if(level = 'ok') AS n_ok FROM krep GROUP BY test_type""", views=[],
    ctes=[KS, KS_P, CHI, KS_REPORT])))
def q_ks_summary(spark, sf):
    """KS report summary."""
    ref, prod = _split(spark, sf, NUM + CAT)
    return dr.ks_summary(dr.ks_report(ref, prod, P))


def _perf_history(spark, sf):
    """Per (signup year, persona): accuracy / precision / recall of the score at 0.5."""
    cust = tb.customers(spark, sf).select("customer_id", "persona", "signup_date", "churn_label")
    sc = tb.scores(spark, sf).select("customer_id", "churn_probability")
    j = cust.join(sc, "customer_id").filter(F.col("signup_date").isNotNull())
    pred = F.col("churn_probability") >= 0.5
    y = F.col("churn_label") == 1
    g = j.groupBy(F.year("signup_date").alias("timestamp"), F.col("persona").alias("model")).agg(
        F.avg((pred == y).cast("double")).alias("accuracy"),
        F.try_divide(F.count_if(pred & y), F.count_if(pred)).alias("precision"),
        F.try_divide(F.count_if(pred & y), F.count_if(y)).alias("recall"))
    return g


HIST = """hist AS (SELECT year(c.signup_date) AS "timestamp", c.persona AS model,
    avg(CAST((s.churn_probability >= 0.5) = (c.churn_label = 1) AS DOUBLE)) AS accuracy,
    count_if(s.churn_probability >= 0.5 AND c.churn_label = 1) / nullif(count_if(s.churn_probability >= 0.5), 0) AS precision,
    count_if(s.churn_probability >= 0.5 AND c.churn_label = 1) / nullif(count_if(c.churn_label = 1), 0) AS recall
  FROM cust c JOIN scores s ON c.customer_id = s.customer_id WHERE c.signup_date IS NOT NULL
  GROUP BY year(c.signup_date), c.persona)"""


def _perf_sql() -> str:
    parts = []
    for m, t in PERF.items():
        parts.append(f"SELECT model, \"timestamp\", '{m}' AS metric, CAST({m} AS DOUBLE) AS value, {t} AS threshold "
                     f"FROM hist")
    return f"""lg AS ({" UNION ALL ".join(parts)}),
lt AS (SELECT model, max("timestamp") AS last FROM hist GROUP BY model),
cur AS (SELECT l.model, l.metric, l.threshold, max(l.value) AS current FROM lg l JOIN lt ON l.model = lt.model
  WHERE l."timestamp" = lt.last GROUP BY l.model, l.metric, l.threshold),
base AS (SELECT l.model, l.metric, max(l.value) AS baseline,
    first(l."timestamp" ORDER BY l.value DESC, l."timestamp") AS baseline_timestamp
  FROM lg l JOIN lt ON l.model = lt.model WHERE l."timestamp" < lt.last AND l.value IS NOT NULL
  GROUP BY l.model, l.metric),
perf AS (SELECT c.model, c.metric, c.threshold, c.current, b.baseline, b.baseline_timestamp,
    CASE WHEN b.baseline IS NOT NULL THEN greatest(0.0, b.baseline - c.current) END AS "drop",
    CASE WHEN b.baseline IS NULL THEN 'insufficient_history'
         WHEN greatest(0.0, b.baseline - c.current) >= c.threshold THEN 'degraded'
         WHEN greatest(0.0, b.baseline - c.current) >= c.threshold * 0.5 AND greatest(0.0, b.baseline - c.current) > 0
           THEN 'warning' ELSE 'ok' END AS status
  FROM cur c LEFT JOIN base b ON c.model = b.model AND c.metric = b.metric)"""


@register("performance_alerts", oracle("SELECT * FROM perf", views=["cust", "scores"], ctes=[HIST, _perf_sql()],
                                       doubles=["threshold", "current", "baseline", "drop"],
                                       ints=["baseline_timestamp"]))
def q_performance_alerts(spark, sf):
    """Latest vs best earlier metric value per model."""
    return dr.performance_alerts(_perf_history(spark, sf), PERF)


RANK = "CASE WHEN level IN ('yellow', 'warning') THEN 1 WHEN level IN ('red', 'drift', 'degraded') THEN 2 ELSE 0 END"


@register("monitor", _recursive(oracle(f"""SELECT max(rank)::BIGINT AS max_rank,
  list_sort(coalesce(list(DISTINCT feature) FILTER (WHERE rank >= 2 AND source <> 'performance'), []::VARCHAR[])) AS drifted_features,
  count_if(rank >= 2) AS n_alerts, ['green', 'yellow', 'red'][max(rank) + 1] AS overall_alert_level
FROM (SELECT *, {RANK} AS rank FROM (
  SELECT 'psi' AS source, feature, level FROM prep UNION ALL SELECT 'ks', feature, level FROM krep
  UNION ALL SELECT 'performance', model || ':' || metric, status FROM perf))""", views=["cust", "scores"],
    ctes=[PSI, KS_TAIL, KS_P, CHI, KS_REPORT, HIST, _perf_sql()])))
def q_monitor(spark, sf):
    """Combined PSI / KS / performance status."""
    ref, prod = _split(spark, sf, NUM + CAT)
    return dr.monitor(dr.psi_report(ref.select(*NUM), prod.select(*NUM), NUM, P), dr.ks_report(ref, prod, P),
                      dr.performance_alerts(_perf_history(spark, sf), PERF))


LEVEL_OF = lambda x: f"CASE WHEN {x} >= {P.psi_red} THEN 'red' WHEN {x} >= {P.psi_yellow} THEN 'yellow' END"
HISTORY = f"""dh AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.psi, 0.0) AS psi, coalesce(b.ks_statistic, 0.0) AS ks_stat,
    b.p_value AS ks_pvalue, coalesce(b.p_value <= {P.ks_drift_p}, false) AS ks_drift FROM prep a FULL JOIN ksp b ON a.feature = b.feature),
dl AS (SELECT *, coalesce({LEVEL_OF('psi')}, CASE WHEN ks_drift THEN 'yellow' ELSE 'green' END) AS alert_level FROM dh),
dt AS (SELECT count_if(alert_level = 'red' OR ks_drift) AS num_drifted_features, coalesce(avg(psi), 0.0) AS psi_mean,
    coalesce(avg(ks_stat), 0.0) AS ks_mean FROM dl)"""


@register("drift_history", _recursive(oracle(f"""SELECT feature_name, psi, ks_stat, ks_pvalue, alert_level, num_drifted_features, psi_mean, ks_mean,
  DATE '{SPLIT}' AS "timestamp", {P.psi_yellow} AS psi_yellow_threshold, {P.psi_red} AS psi_red_threshold,
  {P.ks_drift_p} AS ks_pvalue_threshold, true AS is_initial_check
FROM (SELECT feature AS feature_name, psi, ks_stat, ks_pvalue, alert_level FROM dl
      UNION ALL SELECT '__overall__', psi_mean, ks_mean, NULL, coalesce({LEVEL_OF('psi_mean')}, 'green') FROM dt) CROSS JOIN dt""", views=[],
    ctes=[PSI, KS_TAIL, KS_P, HISTORY], doubles=["psi", "ks_stat", "ks_pvalue", "psi_mean", "ks_mean", "psi_yellow_threshold",
                                                 "psi_red_threshold", "ks_pvalue_threshold"])))
def q_drift_history(spark, sf):
    """Drift history rows with an overall row."""
    ref, prod = _split(spark, sf, NUM)
    return dr.drift_history_rows(dr.psi_report(ref, prod, NUM, P), dr.ks_two_sample(ref, prod, NUM),
                                 F.lit(SPLIT).cast("date"))


@register("trend_guard", oracle("""
SELECT count(ts) AS n_points, coalesce((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0.0) AS span_seconds,
  count(ts) >= 5 AND coalesce((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0.0) >= 5
    AND coalesce((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0.0) >= 3600 AS trend_ok
FROM events""", views=[], doubles=["span_seconds"]))
def q_trend_guard(spark, sf):
    """Trend-density guard on the event timestamps."""
    return dr.trend_guard(tb.read_table(spark, sf, "events"), "ts")


@register("merge_histories", oracle("""
SELECT coalesce(a."timestamp", b."timestamp", c."timestamp") AS "timestamp", coalesce(a.model, b.model, c.model) AS model,
  a.accuracy, b.precision, c.recall
FROM (SELECT "timestamp", model, accuracy FROM hist) a
FULL JOIN (SELECT "timestamp", model, precision FROM hist WHERE precision IS NOT NULL) b
  ON a."timestamp" = b."timestamp" AND a.model = b.model
FULL JOIN (SELECT "timestamp", model, recall FROM hist WHERE recall IS NOT NULL) c
  ON coalesce(a."timestamp", b."timestamp") = c."timestamp" AND coalesce(a.model, b.model) = c.model""",
    views=["cust", "scores"], ctes=[HIST], doubles=["accuracy", "precision", "recall"], ints=["timestamp"]))
def q_merge_histories(spark, sf):
    """Outer merge of metric histories on (timestamp, model)."""
    h = _perf_history(spark, sf)
    return dr.merge_histories(h.select("timestamp", "model", "accuracy"),
                              h.filter(F.col("precision").isNotNull()).select("timestamp", "model", "precision"),
                              h.filter(F.col("recall").isNotNull()).select("timestamp", "model", "recall"))


@register("stream_drift", oracle("SELECT * FROM prep", views=[], ctes=[PSI], doubles=["psi"]))
def q_stream_drift(spark, sf):
    """D9 on a stream: levels after the production rows have gone through the monitor in micro-batches."""
    ref, prod = _split(spark, sf, [*NUM, "l_shipdate"])
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/drift-{uuid.uuid4().hex}"
    sd.write_baseline(ref, NUM, f"{base}/baseline", P)
    prod.repartitionByRange(3, "l_shipdate").drop("l_shipdate").write.parquet(f"{base}/production")
    stream = spark.readStream.schema(", ".join(f"{c} double" for c in NUM)).option("maxFilesPerTrigger", 1).parquet(f"{base}/production")
    sd.monitor_stream(stream, f"{base}/baseline", f"{base}/monitor", f"{base}/checkpoint", P)
    return sd.current_levels(spark, f"{base}/monitor")


SKETCH_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("sketch_quantile_error", oracle("""SELECT feature, prob, count(*) AS n, true AS within_bound
FROM (SELECT * FROM rlong UNION ALL SELECT * FROM plong) CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS prob)
WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature, prob""", views=[], ctes=[f"""rlong AS ({_long_sql('r', NUM)}),
plong AS ({_long_sql('p', NUM)})"""], doubles=["prob"]))
def q_sketch_quantile_error(spark, sf):
    """Daily KLL sketches merged over all days: the exact share of values up to each quantile is within the bound."""
    li = tb.read_table(spark, sf, "lineitem").filter("l_shipdate IS NOT NULL").select("l_shipdate", *NUM)
    merged = sk.merge_sketches(sk.daily_sketches(li, NUM, "l_shipdate"))
    rows = sk.sketch_quantiles(merged, SKETCH_PROBS).select("feature", "n", F.posexplode("quantiles").alias("i", "q"))
    probs = F.array(*[F.lit(x) for x in SKETCH_PROBS])
    wanted = rows.select("feature", "n", "q", probs[F.col("i")].alias("prob"))
    values = dr.long_form(li, NUM).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # Bounded: features x probabilities.
    share = values.join(F.broadcast(wanted), "feature").groupBy("feature", "prob", "n").agg(
        F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("up_to"))
    e = 2 * sk.rank_error()
    ok = (F.col("below") / F.col("n") <= F.col("prob") + e) & (F.col("up_to") / F.col("n") >= F.col("prob") - e)
    return share.select("feature", "prob", "n", ok.alias("within_bound"))
