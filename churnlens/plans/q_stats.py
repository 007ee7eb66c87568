"""Queries: experiment statistics (X1-X23) on the customer arms.

Statistics and effect sizes have DuckDB oracles; p-values need distribution functions
DuckDB lacks, so the p-value reports are rows-only here and unit-tested
(``tests/test_special.py``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import stats as st
from churnlens.plans.catalog import register
from churnlens.plans.domain_sql import oracle
from churnlens.sources import tables as tb

NUMERIC = ["revenue", "orders", "acctbal"]
CATEG = ["persona"]
HIGH_RISK = ("BUILDING", "MACHINERY")
V = ["cust"]


def _exp(spark, sf):
    cust = tb.customers(spark, sf)
    agg = tb.purchases(spark, sf).groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"),
                                                             F.sum("amount").alias("revenue"))
    return cust.join(agg, "customer_id", "left").select(
        "customer_id", F.col("treatment_group").alias("group"), "persona", F.col("churn_label").alias("churned"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("orders", F.lit(0)).alias("orders"),
        (F.coalesce("orders", F.lit(0)) >= 10).cast("int").alias("converted"), "acctbal", "signup_date")


EXP = """exp AS (SELECT c.customer_id, c.treatment_group AS grp, c.persona, c.churn_label AS churned,
    coalesce(a.revenue, 0.0) AS revenue, coalesce(a.orders, 0) AS orders,
    CAST(coalesce(a.orders, 0) >= 10 AS INTEGER) AS converted, c.acctbal, c.signup_date
  FROM cust c LEFT JOIN (SELECT customer_id, count(*) AS orders, sum(amount) AS revenue FROM purchases
                         GROUP BY customer_id) a ON c.customer_id = a.customer_id)"""


#: Normal tail in SQL: phi(z) times the series of z**(2k + 1) / (1 3 5 ... (2k + 1)).
def normal_sf_sql(z: str) -> str:
    """P(Z > z) for z of any sign, as SQL."""
    term = (f"exp((2 * k + 1) * ln(abs({z})) - lgamma(k + 1.5) - (k + 1) * ln(2.0) + 0.5 * ln(pi()))")
    half = f"exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) * list_sum([{term} for k in range(0, 200)])"
    return f"CASE WHEN {z} = 0 THEN 0.5 WHEN abs({z}) > 8 THEN CASE WHEN {z} > 0 THEN 0.0 ELSE 1.0 END ELSE 0.5 - sign({z}) * ({half}) END"


def summ(metric: str) -> str:
    return f"""(SELECT count(CASE WHEN grp = 'treatment' THEN {metric} END) AS n_a,
    count(CASE WHEN grp = 'control' THEN {metric} END) AS n_b,
    sum(CASE WHEN grp = 'treatment' THEN CAST({metric} AS DOUBLE) END) AS sum_a,
    sum(CASE WHEN grp = 'control' THEN CAST({metric} AS DOUBLE) END) AS sum_b,
    avg(CASE WHEN grp = 'treatment' THEN CAST({metric} AS DOUBLE) END) AS mean_a,
    avg(CASE WHEN grp = 'control' THEN CAST({metric} AS DOUBLE) END) AS mean_b,
    var_samp(CASE WHEN grp = 'treatment' THEN CAST({metric} AS DOUBLE) END) AS var_a,
    var_samp(CASE WHEN grp = 'control' THEN CAST({metric} AS DOUBLE) END) AS var_b FROM exp)"""


@register("assign_groups", oracle("""
SELECT customer_id, CASE WHEN rn <= k THEN 'treatment' ELSE 'control' END AS "group"
FROM (SELECT c_custkey AS customer_id, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS rn FROM customer)
CROSS JOIN (SELECT round_even(count(*) * 0.5, 0) AS k FROM customer)""", views=[]))
def q_assign_groups(spark, sf):
    """Seeded exact 50/50 split by a distributed global rank of the seeded hash."""
    ids = tb.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    return st.assign_groups(ids, 0.5, 2, 42)


@register("assign_groups_nway", oracle("""
SELECT customer_id, 'group_' || CAST((rn - 1) % 3 AS VARCHAR) AS "group"
FROM (SELECT c_custkey AS customer_id, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) AS rn FROM customer)""", views=[]))
def q_assign_groups_nway(spark, sf):
    """Equal three-way split."""
    ids = tb.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    return st.assign_groups(ids, None, 3, 7)


def _balance_sql() -> str:
    parts = []
    for c in NUMERIC:
        t = f"CASE WHEN grp = 'treatment' THEN CAST({c} AS DOUBLE) END"
        k = f"CASE WHEN grp = 'control' THEN CAST({c} AS DOUBLE) END"
        parts.append(f"""SELECT '{c}' AS covariate, '' AS level, 'numeric' AS covariate_type, avg({t}) AS tm, avg({k}) AS cm,
  var_samp({t}) AS tv, var_samp({k}) AS cv, count({t}) AS tn, count({k}) AS cn,
  count_if(grp = 'treatment' AND {c} IS NULL) AS missing_treatment, count_if(grp = 'control' AND {c} IS NULL) AS missing_control
  FROM exp WHERE grp IN ('treatment', 'control')""")
    num = " UNION ALL ".join(parts)
    cat = []
    for c in CATEG:
        cat.append(f"""SELECT '{c}' AS covariate, CAST({c} AS VARCHAR) AS level,
  count_if(grp = 'treatment') * 1.0 / (SELECT count_if(grp = 'treatment') FROM exp) AS ts,
  count_if(grp = 'control') * 1.0 / (SELECT count_if(grp = 'control') FROM exp) AS cs,
  (SELECT count_if(grp = 'treatment' AND {c} IS NULL) FROM exp) AS missing_treatment,
  (SELECT count_if(grp = 'control' AND {c} IS NULL) FROM exp) AS missing_control
  FROM exp WHERE grp IN ('treatment', 'control') AND {c} IS NOT NULL GROUP BY {c}""")
    return f"""numb AS ({num}),
catb AS ({" UNION ALL ".join(cat)}),
bal0 AS (
  SELECT covariate, level, covariate_type, tm AS treatment_mean_or_share, cm AS control_mean_or_share,
    tm - cm AS group_difference,
    CASE WHEN tn > 1 AND cn > 1 AND sqrt((tv + cv) / 2) > 0 THEN (tm - cm) / sqrt((tv + cv) / 2)
         WHEN tm - cm IS NOT NULL AND abs(tm - cm) <= 1e-12 THEN 0.0 ELSE 'inf'::DOUBLE END
      AS standardized_mean_difference, missing_treatment, missing_control FROM numb
  UNION ALL
  SELECT covariate, level, 'categorical_level', ts, cs, ts - cs,
    CASE WHEN sqrt((ts * (1 - ts) + cs * (1 - cs)) / 2) > 0 THEN (ts - cs) / sqrt((ts * (1 - ts) + cs * (1 - cs)) / 2)
         WHEN abs(ts - cs) <= 1e-12 THEN 0.0 ELSE 'inf'::DOUBLE END, missing_treatment, missing_control FROM catb),
bal AS (SELECT bal0.*, n_treatment, n_control, 'covariate_balance' AS analysis_role,
    abs(standardized_mean_difference) AS abs_standardized_mean_difference, 0.1 AS threshold,
    CASE WHEN abs(standardized_mean_difference) <= 0.1 THEN 'pass' ELSE 'fail' END AS pass_fail,
    abs(standardized_mean_difference) <= 0.1 AS balance_pass
  FROM bal0 CROSS JOIN (SELECT count_if(grp = 'treatment') AS n_treatment, count_if(grp = 'control') AS n_control
                        FROM exp WHERE grp IN ('treatment', 'control')))"""


BAL_D = ["treatment_mean_or_share", "control_mean_or_share", "group_difference", "standardized_mean_difference",
         "abs_standardized_mean_difference", "threshold"]


@register("balance_check", oracle("SELECT * FROM bal", views=V, ctes=[EXP, _balance_sql()], doubles=BAL_D,
                                  ints=["missing_treatment", "missing_control"]))
def q_balance_check(spark, sf):
    """X2 + X3: numeric and categorical-level standardized mean differences."""
    return st.balance_check(_exp(spark, sf), NUMERIC, CATEG)


@register("balance_summary", oracle("""
SELECT coalesce(analysis_role, '__overall__') AS analysis_role, count(*) AS total_checks,
  count_if(pass_fail = 'pass') AS passed_checks, count_if(pass_fail = 'fail') AS failed_checks,
  max(abs_standardized_mean_difference) AS max_abs_smd, bool_and(pass_fail = 'pass') AS overall_pass
FROM bal GROUP BY ROLLUP (analysis_role)""", views=V, ctes=[EXP, _balance_sql()], doubles=["max_abs_smd"]))
def q_balance_summary(spark, sf):
    """Balance summary by role with an overall rollup row."""
    return st.balance_summary(st.balance_check(_exp(spark, sf), NUMERIC, CATEG))


@register("metric_type", oracle("""SELECT CASE WHEN coalesce(bool_and(CAST(converted AS DOUBLE) IN (0.0, 1.0)), true)
  THEN 'binary' ELSE 'continuous' END AS metric_type FROM exp WHERE converted IS NOT NULL""", views=V, ctes=[EXP]))
def q_metric_type(spark, sf):
    """Metric type detection."""
    return st.metric_type(_exp(spark, sf), "converted")


@register("z_test", oracle(f"""
SELECT CASE WHEN se = 0 THEN 0.0 ELSE (mean_a - mean_b) / se END AS test_statistic,
  2 * (asin(sqrt(mean_a)) - asin(sqrt(mean_b))) AS effect_size, mean_a AS proportion_a, mean_b AS proportion_b,
  mean_a - mean_b AS proportion_diff, 'z_test_proportions' AS test_used
FROM (SELECT *, sqrt(pp * (1 - pp) * (1.0 / n_a + 1.0 / n_b)) AS se
      FROM (SELECT *, (sum_a + sum_b) / (n_a + n_b) AS pp FROM {summ('churned')}))""",
    views=V, ctes=[EXP], doubles=["test_statistic", "effect_size", "proportion_a", "proportion_b", "proportion_diff"]))
def q_z_test(spark, sf):
    """Two-proportion z statistic and Cohen's h on the churn label."""
    return st.z_test(_exp(spark, sf), "churned", with_p=False)


T_SQL = f"""
SELECT (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS test_statistic,
  pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS dof,
  CASE WHEN sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) > 0
       THEN (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) ELSE 0.0 END
    AS effect_size, mean_a, mean_b, mean_a - mean_b AS mean_diff, 'welch_t_test' AS test_used
FROM {summ('revenue')}"""


@register("t_test", oracle(T_SQL, views=V, ctes=[EXP],
                           doubles=["test_statistic", "dof", "effect_size", "mean_a", "mean_b", "mean_diff"]))
def q_t_test(spark, sf):
    """Welch t statistic, degrees of freedom and Cohen's d on revenue."""
    return st.t_test(_exp(spark, sf), "revenue", with_p=False)


def _chi_sql(m: str) -> str:
    cells = [("sum_a", "n_a", "(sum_a + sum_b)"), ("(n_a - sum_a)", "n_a", "(n_a - sum_a + n_b - sum_b)"),
             ("sum_b", "n_b", "(sum_a + sum_b)"), ("(n_b - sum_b)", "n_b", "(n_a - sum_a + n_b - sum_b)")]
    terms = " + ".join(f"pow(greatest(abs({o} - {r} * {c} / (n_a + n_b)) - 0.5, 0.0), 2) / ({r} * {c} / (n_a + n_b))"
                       for o, r, c in cells)
    deg = "(sum_a + sum_b = 0 OR n_a - sum_a + n_b - sum_b = 0 OR n_a = 0 OR n_b = 0)"
    return f"""SELECT CASE WHEN {deg} THEN 0.0 ELSE {terms} END AS chi
FROM {summ(m)}"""


@register("chi_square", oracle(f"""
SELECT chi AS test_statistic, 1 AS dof, sqrt(chi / (n_a + n_b)) AS effect_size, mean_a AS proportion_a,
  mean_b AS proportion_b, 'chi_square' AS test_used
FROM ({_chi_sql('churned')}) CROSS JOIN {summ('churned')}""", views=V, ctes=[EXP],
    doubles=["test_statistic", "effect_size", "proportion_a", "proportion_b"], ints=["dof"]))
def q_chi_square(spark, sf):
    """Yates-corrected 2x2 chi-square and Cramer's V on the churn label."""
    return st.chi_square(_exp(spark, sf), "churned", with_p=False)


@register("mann_whitney", oracle("""
SELECT r1 - na * (na + 1) / 2.0 AS test_statistic,
  CASE WHEN na * nb > 0 THEN 1 - 2 * (r1 - na * (na + 1) / 2.0) / (na * nb) ELSE 0.0 END AS effect_size,
  median_a, median_b, 'mann_whitney_u' AS test_used
FROM (SELECT sum(ca * (cum - t + (t + 1) / 2.0)) AS r1, sum(ca) AS na, sum(cb) AS nb FROM (
        SELECT *, sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM (
          SELECT CAST(revenue AS DOUBLE) AS v, count_if(grp = 'treatment') AS ca, count_if(grp = 'control') AS cb,
                 count(*) AS t FROM exp WHERE grp IN ('treatment', 'control') AND revenue IS NOT NULL GROUP BY 1)))
CROSS JOIN (SELECT median(CASE WHEN grp = 'treatment' THEN revenue END) AS median_a,
                   median(CASE WHEN grp = 'control' THEN revenue END) AS median_b FROM exp)""",
    views=V, ctes=[EXP], doubles=["test_statistic", "effect_size", "median_a", "median_b"]))
def q_mann_whitney(spark, sf):
    """Mann-Whitney U and rank-biserial r from mid-ranks of distinct values."""
    return st.mann_whitney(_exp(spark, sf), "revenue", with_p=False)


@register("significance")
def q_significance(spark, sf):
    """Routed tests with p-values for two metrics (rows-only: p-values)."""
    e = _exp(spark, sf)
    cols = ["test_used", "test_statistic", "effect_size", "p_value"]
    a = st.significance(e, "churned").select(F.lit("churned").alias("metric"), *cols)
    b = st.significance(e, "revenue").select(F.lit("revenue").alias("metric"), *cols)
    c = st.significance(e, "revenue", test="mann_whitney").select(F.lit("revenue_mw").alias("metric"), *cols)
    return a.unionByName(b).unionByName(c)


Z95 = st._N.inv_cdf(0.975)


@register("effect_ci", oracle(f"""
SELECT 'revenue' AS metric, n_a, n_b, mean_a, mean_b, mean_a - mean_b AS effect,
  sqrt(var_a / n_a + var_b / n_b) AS standard_error,
  mean_a - mean_b - {Z95!r} * sqrt(var_a / n_a + var_b / n_b) AS ci_lower,
  mean_a - mean_b + {Z95!r} * sqrt(var_a / n_a + var_b / n_b) AS ci_upper FROM {summ('revenue')}""",
    views=V, ctes=[EXP], doubles=["mean_a", "mean_b", "effect", "standard_error", "ci_lower", "ci_upper"]))
def q_effect_ci(spark, sf):
    """X11: difference in means with a 95% normal confidence interval."""
    return st.effect_ci(_exp(spark, sf), "revenue")


@register("experiment_summary", oracle(f"""
SELECT 'converted' AS metric, n_a, n_b, mean_a, mean_b, mean_a - mean_b AS difference,
  CASE WHEN mean_b <> 0 THEN (mean_a - mean_b) / abs(mean_b) WHEN mean_a <> 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS relative_lift,
  mean_a - mean_b - {st._N.inv_cdf(0.975)!r} * sqrt(var_a / n_a + var_b / n_b) AS ci_lower,
  mean_a - mean_b + {st._N.inv_cdf(0.975)!r} * sqrt(var_a / n_a + var_b / n_b) AS ci_upper
FROM {summ('converted')}""", views=V, ctes=[EXP],
    doubles=["mean_a", "mean_b", "difference", "relative_lift", "ci_lower", "ci_upper"]))
def q_experiment_summary(spark, sf):
    """Experiment summary with relative lift."""
    return st.experiment_summary(_exp(spark, sf), "converted", with_test=False)


@register("experiment_summary_tested", oracle(f"""
SELECT * EXCLUDE (zv), zv AS test_statistic, p_value < 0.05 AS is_significant FROM (
  SELECT *, least(1.0, CASE WHEN zv = 0 THEN 1.0 ELSE 2 * ({normal_sf_sql("abs(zv)")}) END) AS p_value FROM (
    SELECT 'converted' AS metric, n_a, n_b, mean_a, mean_b, mean_a - mean_b AS difference,
      CASE WHEN mean_b <> 0 THEN (mean_a - mean_b) / abs(mean_b) WHEN mean_a <> 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS relative_lift,
      mean_a - mean_b - {Z95!r} * sqrt(var_a / n_a + var_b / n_b) AS ci_lower,
      mean_a - mean_b + {Z95!r} * sqrt(var_a / n_a + var_b / n_b) AS ci_upper, 'z_test_proportions' AS test_used,
      CASE WHEN pp = 0 OR pp = 1 THEN 0.0 ELSE (mean_a - mean_b) / sqrt(pp * (1 - pp) * (1.0 / n_a + 1.0 / n_b)) END AS zv
    FROM (SELECT *, (sum_a + sum_b) / (n_a + n_b) AS pp FROM {summ('converted')})))""", views=V, ctes=[EXP],
    doubles=["mean_a", "mean_b", "difference", "relative_lift", "ci_lower", "ci_upper", "test_statistic", "p_value"]))
def q_experiment_summary_tested(spark, sf):
    """The summary with its test."""
    return st.experiment_summary(_exp(spark, sf), "converted")


MULTI = ["churned", "converted", "revenue", "orders"]


def _multi_sql() -> str:
    rows = []
    for m in MULTI:
        binary = m in ("churned", "converted")
        if binary:
            stat = f"(SELECT chi FROM ({_chi_sql(m)}))"
            rows.append(f"SELECT '{m}' AS metric, 'chi_square' AS test_used, {stat} AS test_statistic, 1.0 AS dof, "
                        f"mean_a, mean_b FROM {summ(m)}")
        else:
            rows.append(f"""SELECT '{m}', 'welch_t_test', (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b),
  pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)),
  mean_a, mean_b FROM {summ(m)}""")
    return " UNION ALL ".join(rows)


@register("multi_test_stats", oracle(_multi_sql(), views=V, ctes=[EXP],
                                     doubles=["test_statistic", "dof", "mean_a", "mean_b"]))
def q_multi_test_stats(spark, sf):
    """Per-metric chi-square (binary) or Welch statistics in one unpivoted pass."""
    return st.multi_test_stats(_exp(spark, sf), MULTI)


@register("multi_test_fdr")
def q_multi_test_fdr(spark, sf):
    """X13 + X15: p-values with Benjamini-Hochberg correction (rows-only: p-values)."""
    return st.multi_test(_exp(spark, sf), MULTI, method="fdr_bh")


@register("multi_test_bonferroni")
def q_multi_test_bonferroni(spark, sf):
    """Bonferroni-corrected multi-metric tests (rows-only: p-values)."""
    return st.multi_test(_exp(spark, sf), MULTI, method="bonferroni")


@register("multi_test_holm")
def q_multi_test_holm(spark, sf):
    """Holm-corrected multi-metric tests (rows-only: p-values)."""
    return st.multi_test(_exp(spark, sf), MULTI, method="holm")


#: A family of p-values from the data: one per nation and market segment.
FAMILY = """fam AS (SELECT c_nationkey || ':' || c_mktsegment AS metric, least(avg(abs(c_acctbal)) / 100000.0, 1.0) AS p_value
  FROM customer GROUP BY 1)"""


def _family(spark, sf):
    c = tb.read_table(spark, sf, "customer")
    return c.groupBy(F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("metric")).agg(
        F.least(F.avg(F.abs("c_acctbal")) / 100000.0, F.lit(1.0)).alias("p_value"))


def _adjusted_sql(value: str, method: str) -> str:
    return oracle(f"""SELECT metric, p_value, p_adjusted, p_adjusted < 0.05 AS significant, '{method}' AS correction
FROM (SELECT metric, p_value, least({value}, 1.0) AS p_adjusted FROM (
  SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, metric) AS i FROM fam))""",
                  views=[], ctes=[FAMILY], doubles=["p_value", "p_adjusted"])


@register("adjust_bonferroni", _adjusted_sql("p_value * m", "bonferroni"))
def q_adjust_bonferroni(spark, sf):
    """Bonferroni correction of a family of p-values."""
    return st.correct(_family(spark, sf), "bonferroni")


@register("adjust_holm", _adjusted_sql("max(p_value * (m - i + 1)) OVER (ORDER BY p_value, metric)", "holm"))
def q_adjust_holm(spark, sf):
    """Holm correction of a family of p-values."""
    return st.correct(_family(spark, sf), "holm")


@register("adjust_fdr", _adjusted_sql("min(p_value * m / i) OVER (ORDER BY p_value DESC, metric DESC)", "fdr_bh"))
def q_adjust_fdr(spark, sf):
    """Benjamini-Hochberg correction of a family of p-values."""
    return st.correct(_family(spark, sf), "fdr_bh")


MDES = (0.01, 0.02, 0.05)
ZA, ZB = st.z_quantiles(0.05, 0.80)


def _baselines(spark, sf):
    return (_exp(spark, sf).groupBy("persona").agg(F.avg(F.col("churned").cast("double")).alias("baseline_rate"),
                                                   F.count(F.lit(1)).alias("n")))


@register("sample_size", oracle(f"""
SELECT persona, baseline_rate, mde,
  CAST(ceil(pow({ZA!r} * sqrt(2 * pav * (1 - pav)) + {ZB!r} * sqrt(baseline_rate * (1 - baseline_rate)
       + (baseline_rate + mde) * (1 - (baseline_rate + mde))), 2) / pow(mde, 2)) AS BIGINT) AS sample_size
FROM (SELECT persona, avg(CAST(churned AS DOUBLE)) AS baseline_rate FROM exp GROUP BY persona)
CROSS JOIN (VALUES {", ".join(f"({m})" for m in MDES)}) AS g(mde)
CROSS JOIN LATERAL (SELECT (baseline_rate + baseline_rate + mde) / 2 AS pav)""",
    views=V, ctes=[EXP], doubles=["baseline_rate", "mde"]))
def q_sample_size(spark, sf):
    """Required sample size per persona baseline and MDE."""
    b = _baselines(spark, sf).select("persona", "baseline_rate")
    g = spark.createDataFrame([(m,) for m in MDES], "mde double")
    j = b.crossJoin(F.broadcast(g))
    return j.withColumn("sample_size", st.sample_size_expr(F.col("baseline_rate"), F.col("mde")).cast("long"))


@register("power_mde")
def q_power_mde(spark, sf):
    """Power at the observed arm size and MDE by bisection per persona (rows-only)."""
    b = _baselines(spark, sf).withColumn("n_per_arm", (F.col("n") / 2).cast("double"))
    return b.select("persona", "baseline_rate", "n_per_arm",
                    st.power(F.col("n_per_arm"), F.col("baseline_rate"), F.lit(0.05)).alias("power_at_5pt"),
                    st.mde_udf(F.col("n_per_arm"), F.col("baseline_rate")).alias("mde"))


@register("power_curve")
def q_power_curve(spark, sf):
    """Power over a size x effect grid for every persona baseline (rows-only)."""
    b = _baselines(spark, sf).select("persona", "baseline_rate")
    return st.power_grid(b, [100, 500, 1000, 5000], [0.01, 0.02, 0.05], sign=-1)


LOOKS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01"]


@register("interim_looks", oracle(f"""
SELECT look, count(CASE WHEN grp = 'treatment' THEN churned END) AS n_treatment,
  count(CASE WHEN grp = 'control' THEN churned END) AS n_control,
  avg(CASE WHEN grp = 'treatment' THEN CAST(churned AS DOUBLE) END) AS treatment_mean,
  avg(CASE WHEN grp = 'control' THEN CAST(churned AS DOUBLE) END) AS control_mean,
  sum(CASE WHEN grp = 'treatment' THEN CAST(churned AS DOUBLE) END) AS sum_a,
  sum(CASE WHEN grp = 'control' THEN CAST(churned AS DOUBLE) END) AS sum_b,
  var_samp(CASE WHEN grp = 'treatment' THEN CAST(churned AS DOUBLE) END) AS var_a,
  var_samp(CASE WHEN grp = 'control' THEN CAST(churned AS DOUBLE) END) AS var_b,
  count(CASE WHEN grp = 'treatment' THEN churned END) + count(CASE WHEN grp = 'control' THEN churned END) AS n_total,
  avg(CASE WHEN grp = 'treatment' THEN CAST(churned AS DOUBLE) END)
    - avg(CASE WHEN grp = 'control' THEN CAST(churned AS DOUBLE) END) AS absolute_diff
FROM exp JOIN (VALUES {", ".join(f"({i + 1}, DATE '{c}')" for i, c in enumerate(LOOKS))}) AS l(look, cutoff)
  ON exp.signup_date <= l.cutoff GROUP BY look""", views=V, ctes=[EXP],
    doubles=["treatment_mean", "control_mean", "sum_a", "sum_b", "var_a", "var_b", "absolute_diff"], ints=["look"]))
def q_interim_looks(spark, sf):
    """Cumulative interim snapshots by signup date."""
    return st.interim_looks(_exp(spark, sf), "churned", "signup_date", LOOKS)


@register("sequential_test")
def q_sequential_test(spark, sf):
    """O'Brien-Fleming alpha spending over the interim looks (rows-only: p-values)."""
    return st.sequential_test(st.interim_looks(_exp(spark, sf), "churned", "signup_date", LOOKS), len(LOOKS))


def _arms(spark, sf):
    e = _exp(spark, sf)
    parts = [st.arm_summary(e, m).select(F.lit(m).alias("experiment"), "n_a", "n_b", "mean_a", "mean_b")
             for m in ("churned", "converted")]
    return parts[0].unionByName(parts[1])


@register("experiment_readout")
def q_experiment_readout(spark, sf):
    """Readout per binary metric with test, power and significance gate (rows-only: p-values)."""
    return st.experiment_readout(_arms(spark, sf))


@register("experiment_readout_summary")
def q_experiment_readout_summary(spark, sf):
    """Summary over the experiments (rows-only: it follows the gate)."""
    return st.readout_summary(st.experiment_readout(_arms(spark, sf)))


def _readout_sql() -> str:
    one = " UNION ALL ".join(f"""SELECT '{m}' AS experiment, n_a, n_b, mean_a, mean_b FROM {summ(m)}"""
                             for m in ("churned", "converted"))
    return f"""SELECT experiment, n_a, n_b, mean_a, mean_b, e AS absolute_effect,
  CASE WHEN mean_b <> 0 THEN -e / abs(mean_b) ELSE 0.0 END AS lift, e - {Z95!r} * se AS ci_lower, e + {Z95!r} * se AS ci_upper,
  abs(2 * (asin(sqrt(least(greatest(mean_a, 1e-6), 1 - 1e-6))) - asin(sqrt(least(greatest(mean_b, 1e-6), 1 - 1e-6))))) AS cohens_h,
  CAST(ceil(pow({ZA!r} * sqrt((b + b + m) * (1 - (b + b + m) / 2)) + {ZB!r} * sqrt(b * (1 - b) + (b + m) * (1 - b - m)), 2)
       / pow(m, 2)) AS BIGINT) AS required_sample_size
FROM (SELECT *, mean_a - mean_b AS e, greatest(abs(mean_a - mean_b), 0.01) AS m,
        CASE WHEN mean_b > 0 AND mean_b < 1 THEN mean_b ELSE 0.5 END AS b,
        sqrt(mean_a * (1 - mean_a) / greatest(n_a - 1, 1) + mean_b * (1 - mean_b) / greatest(n_b - 1, 1)) AS se FROM ({one}))"""


@register("experiment_effects", oracle(_readout_sql(), views=V, ctes=[EXP], doubles=[
    "mean_a", "mean_b", "absolute_effect", "lift", "ci_lower", "ci_upper", "cohens_h"]))
def q_experiment_effects(spark, sf):
    """The readout without its p-value and power."""
    return st.experiment_readout(_arms(spark, sf), with_p=False)


SLICES = f"""
SELECT slice, n_treatment, n_control, treatment_rate, control_rate,
  CASE WHEN se = 0 THEN 0.0 ELSE (treatment_rate - control_rate) / se END AS z_statistic,
  treatment_rate - control_rate AS effect,
  CASE WHEN control_rate <> 0 THEN (control_rate - treatment_rate) / abs(control_rate) ELSE 0.0 END AS lift,
  CAST(ceil(pow({ZA!r} * sqrt((b + b + 0.05) * (1 - (b + b + 0.05) / 2)) + {ZB!r} * sqrt(b * (1 - b) + (b + 0.05) * (1 - b - 0.05)), 2)
       / pow(0.05, 2)) AS BIGINT) AS required_sample_size
FROM (SELECT *, least(greatest(pp, 0.01), 0.94) AS b, max(slice = 'high_risk_personas') OVER () AS has_high, sqrt(pp * (1 - pp) * (1.0 / n_treatment + 1.0 / n_control)) AS se FROM (
  SELECT slice, count_if(grp = 'treatment') AS n_treatment, count_if(grp = 'control') AS n_control,
    avg(CASE WHEN grp = 'treatment' THEN v END) AS treatment_rate, avg(CASE WHEN grp = 'control' THEN v END) AS control_rate,
    (sum(CASE WHEN grp = 'treatment' THEN v END) + sum(CASE WHEN grp = 'control' THEN v END))
      / (count_if(grp = 'treatment') + count_if(grp = 'control')) AS pp
  FROM (SELECT grp, CAST(churned AS DOUBLE) AS v, 'all_customers' AS slice FROM exp
        UNION ALL SELECT grp, CAST(churned AS DOUBLE), 'high_risk_personas' FROM exp
          WHERE persona IN {HIGH_RISK!r}
        UNION ALL SELECT grp, CAST(churned AS DOUBLE), 'early_signups' FROM exp
          WHERE date_diff('day', DATE '1970-01-01', signup_date)
                <= (SELECT median(date_diff('day', DATE '1970-01-01', signup_date)) FROM exp))
  GROUP BY slice) WHERE n_treatment >= 30 AND n_control >= 30) WHERE slice <> 'early_signups' OR NOT has_high"""


@register("campaign_slices", oracle(SLICES,
    views=V, ctes=[EXP], doubles=["treatment_rate", "control_rate", "z_statistic", "effect", "lift"]))
def q_campaign_slices(spark, sf):
    """Campaign test slices with at least 30 per arm."""
    c = _exp(spark, sf).withColumnRenamed("group", "treatment_group").withColumnRenamed("churned", "churn_label")
    return st.campaign_slices(c, "churn_label", 30, HIGH_RISK, with_p=False)


#: A nation's suppliers against its customers. The counts of orders by U are the coefficients of the Gaussian
#: binomial, built factor by factor of the smaller arm.
MW_NATION = f"""arms AS (SELECT s_nationkey AS k, 1 AS a, s_acctbal AS v FROM supplier UNION ALL SELECT c_nationkey, 0, c_acctbal FROM customer),
ok AS (SELECT * FROM arms WHERE v IS NOT NULL),
vals AS (SELECT k, v, sum(a) AS ca, sum(1 - a) AS cb, count(*) AS t FROM ok GROUP BY k, v),
rk AS (SELECT *, sum(t) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM vals),
s AS (SELECT k, sum(ca)::BIGINT AS n_a, sum(cb)::BIGINT AS n_b, sum(ca * (cum - t + (t + 1) / 2.0)) AS r1, sum(t ** 3 - t) AS ties FROM rk GROUP BY k),
u AS (SELECT *, CASE WHEN n_a * n_b > 0 THEN r1 - n_a * (n_a + 1) / 2.0 END AS u, (n_a + n_b)::DOUBLE AS n FROM s),
z AS (SELECT *, sqrt(n_a * n_b / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS sigma, least(n_a, n_b) AS m, greatest(n_a, n_b) AS o,
    least(u, n_a * n_b - u) AS low FROM u),
zz AS (SELECT *, CASE WHEN sigma > 0 THEN (n_a * n_b / 2.0 - low - 0.5) / sigma ELSE 0.0 END AS zv FROM z),
g(k, i, m, o, p) AS (
  SELECT k, 0, m, o, [1.0::DOUBLE] FROM zz WHERE m BETWEEN 1 AND 8 AND ties = 0
  UNION ALL SELECT k, i + 1, m, o, [list_sum([
      CASE WHEN x - (i + 1) * j < len(p) THEN p[x - (i + 1) * j + 1] ELSE 0.0 END
      - CASE WHEN x - (i + 1) * j - (o + i + 1) >= 0 AND x - (i + 1) * j - (o + i + 1) < len(p) THEN p[x - (i + 1) * j - (o + i + 1) + 1] ELSE 0.0 END
      for j in range(0, x // (i + 1) + 1)]) for x in range(0, (i + 1) * o + 1)]
  FROM g WHERE i < m),
e AS (SELECT k, p FROM g WHERE i = m),
res AS (SELECT zz.k, u, n_a, n_b, CASE WHEN e.p IS NOT NULL THEN least(1.0, 2 * list_sum(e.p[1:CAST(low AS BIGINT) + 1]) / list_sum(e.p))
    ELSE least(1.0, 2 * ({normal_sf_sql("zv")})) END AS p_value FROM zz LEFT JOIN e ON zz.k = e.k)"""


@register("mann_whitney_by_nation", f"""WITH RECURSIVE {MW_NATION}
SELECT CAST(k AS BIGINT) AS nation, round(u, 6) + 0.0 AS test_statistic, n_a, n_b,
  round(CASE WHEN n_a * n_b > 0 THEN 1 - 2 * u / (n_a * n_b) ELSE 0.0 END, 6) + 0.0 AS effect_size,
  round(CASE WHEN u IS NOT NULL THEN p_value END, 6) + 0.0 AS p_value FROM res""")
def q_mann_whitney_by_nation(spark, sf):
    """Balances of each nation's suppliers against its customers', exact for small arms without ties."""
    sup = tb.read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(st.A).alias("group"),
                                                       F.col("s_acctbal").alias("balance"))
    cust = tb.read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(st.B).alias("group"),
                                                        F.col("c_acctbal").alias("balance"))
    return st.mann_whitney(sup.unionByName(cust), "balance", by=["nation"]).select(
        "nation", "test_statistic", "n_a", "n_b", "effect_size", "p_value")


@register("campaign_results", oracle(f"""SELECT *, p_value < 0.05 AND treatment_rate < control_rate AS is_significant FROM (
  SELECT *, CASE WHEN z_statistic = 0 THEN 1.0 ELSE least(1.0, 2 * ({normal_sf_sql("abs(z_statistic)")})) END AS p_value FROM ({SLICES}))""",
    views=V, ctes=[EXP], doubles=["treatment_rate", "control_rate", "z_statistic", "effect", "lift", "p_value"]))
def q_campaign_results(spark, sf):
    """Campaign slices with p-value and significance gate."""
    c = _exp(spark, sf).withColumnRenamed("group", "treatment_group").withColumnRenamed("churned", "churn_label")
    return st.campaign_slices(c, "churn_label", 30, HIGH_RISK)
