"""Survival analysis (K1-K9).

Kaplan-Meier aggregates by distinct duration first (durations are whole days, so the
table is bounded by the time horizon, not by the number of customers), then the
at-risk counts and the running product come from distributed prefix sums (the product
as exp(sum(log(1 - d/n))) plus a count of d = n factors that make it 0).

Cox proportional hazards: damped Newton steps on the Efron partial likelihood with an L2
penalty on standardised features. Each evaluation is an aggregate grouped by duration (sums of w, w x, w x x'
over all rows and over the events) and one global order of the durations; one row comes to the driver.
The largest linear predictor is taken off before ``exp``, so no weight overflows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.asof import asof
from churnlens.functions.prefix import global_order
from churnlens.session import cut_lineage


# ------------------------------------------------------------------ K1, K2

def km_curve(df: DataFrame, duration: str = "duration", event: str = "event",
             group_cols: list[str] | None = None, origin: bool = True) -> DataFrame:
    """K1: ``(group..., time, at_risk, events, censored, survival)`` with S(t) = prod(1 - d/n);
    with ``origin`` also the row at time 0 (all at risk, S = 1) unless a duration is 0."""
    g = list(group_cols or [])
    steps = km_steps(df, duration, event, g)
    out = steps.select(*g, "time", "at_risk", "events", "censored", "survival")
    if not origin:
        return out
    zero = steps.filter((F.col("at_risk") == F.col("total")) & (F.col("time") > 0))
    return out.unionByName(zero.select(*g, F.lit(0.0).alias("time"), "at_risk", F.lit(0).cast("long").alias("events"),
                                       F.lit(0).cast("long").alias("censored"), F.lit(1.0).alias("survival")))


def km_steps(df: DataFrame, duration: str, event: str, g: list[str]) -> DataFrame:
    """The distinct durations of each group with the numbers at risk, of events so far and in all."""
    v = df.groupBy(*g, F.col(duration).cast("double").alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    o = global_order(v, [("time", True)], partition_by=g, sums={"__cn": "n", "cum_events": "events"},
                     totals={"total": "__cn"}, rank_col=None)
    o = o.withColumn("at_risk", (F.col("total") - F.col("__cn") + F.col("n")).cast("long"))
    full = F.col("events") >= F.col("at_risk")
    o = o.withColumn("__lg", F.when(full | (F.col("events") == 0), 0.0)
                     .otherwise(F.log(1 - F.try_divide("events", "at_risk"))))
    o = o.withColumn("__z", F.when(full & (F.col("events") > 0), 1.0).otherwise(0.0))
    o = global_order(o.drop("__cn"), [("time", True)], partition_by=g, sums={"__slg": "__lg", "__sz": "__z"},
                     rank_col=None)
    return o.select(*g, "time", "at_risk", "events", (F.col("n") - F.col("events")).alias("censored"),
                    F.when(F.col("__sz") > 0, 0.0).otherwise(F.exp("__slg")).alias("survival"),
                    F.col("cum_events").cast("long").alias("cum_events"), F.col("total").cast("long").alias("total"))


def km_by_segment(df: DataFrame, segment: str, grid: list[float], duration: str = "duration",
                  event: str = "event", band: float = 0.05) -> DataFrame:
    """K2: per segment KM sampled on a time grid (step lookup; 1 before the first time),
    at-risk and cumulative events at each grid time, first grid time with S <= .5, band.

    The grid times are looked up in the segment's steps by an as-of merge, so durations may be
    continuous: no step meets more than its own place in the order.
    """
    df = df.filter(F.col(duration).isNotNull())
    steps = cut_lineage(km_steps(df, duration, event, [segment]))
    totals = steps.groupBy(segment).agg(F.max("total").alias("__all"))
    times = F.explode(F.array(*[F.lit(float(t)) for t in grid]))        # a parameter
    found = asof(totals.select(segment, "__all", times.alias("t")), steps, "t", "time",
                 ["at_risk", "events", "censored", "survival", "cum_events"], by=[segment])
    # Those with a duration of t or more: still at risk at a step of t, else those left after the step.
    left = F.col("at_risk") - F.col("events") - F.col("censored")
    out = found.select(segment, "t", F.coalesce("survival", F.lit(1.0)).alias("survival"),
                       F.coalesce(F.when(F.col("time") == F.col("t"), F.col("at_risk")).otherwise(left), F.col("__all")).alias("n_at_risk"),
                       F.coalesce("cum_events", F.lit(0).cast("long")).alias("n_events"))
    median = F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).over(Window.partitionBy(segment))    # the grid's rows
    return (out.withColumn("median_survival_days", median)
            .withColumn("ci_lower", F.greatest(F.col("survival") - band, F.lit(0.0)))
            .withColumn("ci_upper", F.least(F.col("survival") + band, F.lit(1.0))))


# ------------------------------------------------------------------ K3-K5

def _standardize(df: DataFrame, features: list[str]):
    st = df.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    mean = np.array([st[f"m_{c}"] or 0.0 for c in features])
    sd = np.array([st[f"s_{c}"] or 1.0 for c in features])
    sd[sd == 0] = 1.0
    return mean, sd


def _eta(beta) -> Column:
    return sum((F.col(f"__z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))


def _shift(base: DataFrame, beta) -> float:
    """The largest linear predictor."""
    return float(base.agg(F.max(_eta(beta))).first()[0] or 0.0) if np.any(beta) else 0.0


def _cox_sums(base: DataFrame, beta, shift: float, weights_only: bool = False) -> DataFrame:
    """Per distinct time the sums of w, w z and w z z' over its rows and over its events, for weights
    exp(eta - shift)."""
    p = len(beta)
    eta = _eta(beta)
    ev = F.col("__e") == 1
    d = base.withColumn("__eta", eta).withColumn("__w", F.exp(eta - F.lit(shift)))
    terms = {"w": F.col("__w")}
    if not weights_only:
        terms |= {f"w{i}": F.col("__w") * F.col(f"__z{i}") for i in range(p)}
        terms |= {f"w{i}_{k}": F.col("__w") * F.col(f"__z{i}") * F.col(f"__z{k}") for i in range(p) for k in range(i, p)}
    aggs = [F.sum(x).alias(f"r_{n}") for n, x in terms.items()] + [F.count_if(ev).alias("d")]
    if not weights_only:
        aggs += [F.sum(F.when(ev, x).otherwise(0.0)).alias(f"e_{n}") for n, x in terms.items()]
        aggs += [F.sum(F.when(ev, F.col("__eta")).otherwise(0.0)).alias("e_eta")]
        aggs += [F.sum(F.when(ev, F.col(f"__z{i}")).otherwise(0.0)).alias(f"e_z{i}") for i in range(p)]
    return d.groupBy("__t").agg(*aggs)


#: Tied events of one time that one row stands for before the sums over ties are taken.
TIE_BLOCK = 4096


def _cox_step(base: DataFrame, beta, penalizer: float):
    """(log-likelihood, gradient, Hessian) of Efron's penalised partial likelihood at ``beta``.

    The risk sets are one running sum over the distinct times, latest first; the sum over the
    l-th of d tied events explodes l on the executors. One row comes to the driver. Where a risk set's
    weights all vanish beside the largest one the likelihood is minus infinity.
    """
    p = len(beta)
    shift = _shift(base, beta)
    t = _cox_sums(base, beta, shift)
    names = ["w", *[f"w{i}" for i in range(p)], *[f"w{i}_{k}" for i in range(p) for k in range(i, p)]]
    risk = global_order(t, [("__t", False)], sums={f"R_{n}": f"r_{n}" for n in names}, rank_col=None).filter("d > 0")
    once = risk.agg(F.sum("e_eta").alias("ll"), *[F.sum(f"e_z{i}").alias(f"g{i}") for i in range(p)])
    cols = ["d", *[f"{x}_{n}" for n in names for x in ("R", "e")]]
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = risk.select(*cols, F.explode(F.expr(f"sequence(0L, (d - 1) div {TIE_BLOCK})")).alias("b")).repartition(parts)
    ties = blocks.select(*cols, F.explode(F.expr(
        f"sequence(b * {TIE_BLOCK}, least((b + 1) * {TIE_BLOCK}, d) - 1)")).alias("l"))
    f = F.col("l") / F.col("d")
    a = {n: F.col(f"R_{n}") - f * F.col(f"e_{n}") for n in names}
    ties = ties.select(*[x.alias(n) for n, x in a.items()])
    m = [F.try_divide(f"w{i}", "w") for i in range(p)]
    sums = ties.agg(F.sum(F.log("w")).alias("ll"), F.count(F.lit(1)).alias("n"), F.count_if(~(F.col("w") > 0)).alias("vanished"),
                    *[F.sum(m[i]).alias(f"g{i}") for i in range(p)],
                    *[F.sum(F.try_divide(f"w{i}_{k}", "w") - m[i] * m[k]).alias(f"h{i}_{k}")
                      for i in range(p) for k in range(i, p)])
    r0, r1 = once.first(), sums.first()
    value = lambda r, c: float(r[c] or 0.0)
    ll = value(r0, "ll") - value(r1, "ll") - shift * value(r1, "n") - 0.5 * penalizer * float(beta @ beta)
    ll = ll if not r1["vanished"] else -math.inf
    g = np.array([value(r0, f"g{i}") - value(r1, f"g{i}") for i in range(p)]) - penalizer * beta
    h = np.zeros((p, p))
    for i in range(p):
        for k in range(i, p):
            h[i, k] = h[k, i] = -value(r1, f"h{i}_{k}")
    return ll, g, h - penalizer * np.eye(p)


def fit_cox(df: DataFrame, features: list[str], duration: str = "duration", event: str = "event",
            penalizer: float = 0.01, max_iter: int = 20, tol: float = 1e-9) -> dict:
    """K3: Efron partial likelihood, damped Newton-Raphson, L2 penalty on standardised X.

    A step is halved until the penalised likelihood rises enough, so the likelihood never falls. Returns the
    coefficients on the original scale, the standardisation, the gradient and the log-likelihood there, the
    likelihood after each step, ``converged`` (false if the steps ran out, as they do for groups that a
    feature separates when there is no penalty: the coefficients then are no estimate) and ``baseline``, a
    checkpointed table (time, cum_hazard) of Breslow's estimate.
    """
    mean, sd = _standardize(df, features)
    zc = [((F.col(c).cast("double") - float(m)) / float(s)).alias(f"__z{i}")
          for i, (c, m, s) in enumerate(zip(features, mean, sd))]
    # every Newton step reads the standardised design: checkpoint it once (lineage cut)
    base = cut_lineage(df.select(F.col(duration).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"), *zc)
                       .filter("__t IS NOT NULL"))
    beta = np.zeros(len(features))
    ll, g, h = _cox_step(base, beta, penalizer)
    path, converged = [ll], not features
    for _ in range(max_iter if features else 0):
        try:
            step = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:                   # a feature that the likelihood does not depend on
            step = -np.linalg.lstsq(h, g, rcond=None)[0]
        if not np.all(np.isfinite(step)):
            break
        gain, size = float(g @ step), 1.0
        if gain < 1e-12 * max(1.0, abs(ll)):            # nothing left to gain, to rounding
            converged = float(np.max(np.abs(step))) < 1e-3
            if converged and gain > 0:                  # a last full step: Newton's error is squared by it
                beta = beta + step
                ll, g, h = _cox_step(base, beta, penalizer)
            break
        while True:                                     # halve until the penalised likelihood rises
            trial = _cox_step(base, beta + size * step, penalizer)
            if trial[0] >= ll + 1e-4 * size * gain or size < 1e-6:
                break
            size /= 2
        if not trial[0] > ll:
            break
        beta, (ll, g, h) = beta + size * step, trial
        path.append(ll)
        if size * float(np.max(np.abs(step))) < tol:
            converged = True
            break
    shift = _shift(base, beta)
    t = _cox_sums(base, beta, shift, weights_only=True)
    hazard = global_order(t, [("__t", False)], sums={"risk": "r_w"}, rank_col=None).select(
        F.col("__t").alias("time"), (F.coalesce(F.try_divide("d", "risk"), F.lit(0.0)) * math.exp(-shift)).alias("dh"))
    baseline = cut_lineage(global_order(hazard, [("time", True)], sums={"cum_hazard": "dh"}, rank_col=None).drop("dh"))
    return {"features": features, "coef": (beta / sd).tolist(), "beta_std": beta.tolist(), "mean": mean.tolist(),
            "sd": sd.tolist(), "baseline": baseline, "log_likelihood": ll, "gradient": g.tolist(), "converged": converged,
            "iterations": len(path) - 1, "likelihood_path": path}


def _lin_pred(model: dict) -> Column:
    return sum((F.col(c).cast("double") - m) / s * b for c, m, s, b in
               zip(model["features"], model["mean"], model["sd"], model["beta_std"]))


def cox_predict(df: DataFrame, model: dict, times=(30.0, 90.0, 365.0), id_col: str = "customer_id") -> DataFrame:
    """K4 + K5: partial hazard exp(x'b) (centred), S(t) = exp(-H0(t) * hazard) at the given times
    (the last known time up to t, else the first) and the median, the first time with S <= 1/2
    (infinite if there is none).

    S(t) <= 1/2 where H0(t) >= ln 2 / hazard: rows and baseline steps are put into one global
    order of that value, the number of steps above a row names its step.
    """
    base = model["baseline"]
    at = base.agg(F.min_by("cum_hazard", "time").alias("h_first"), *[
        F.max(F.when(F.col("time") <= t, F.col("cum_hazard"))).alias(f"h{i}") for i, t in enumerate(times)]).first()
    out = df.withColumn("partial_hazard", F.exp(_lin_pred(model)))
    for i, t in enumerate(times):
        h = at[f"h{i}"] if at[f"h{i}"] is not None else at["h_first"]
        out = out.withColumn(f"survival_{int(t)}", F.exp(-F.lit(float(h or 0.0)) * F.col("partial_hazard")))
    steps = base.groupBy(F.col("cum_hazard").alias("x")).agg(F.min("time").alias("time"))
    steps = global_order(steps, [("x", False)], rank_col="step")
    rows = out.select(F.col(id_col).alias("id"), (F.lit(math.log(2.0)) / F.col("partial_hazard")).alias("x"), F.lit(1).alias("kind"))
    union = rows.unionByName(steps.select(F.lit(None).cast(df.schema[id_col].dataType).alias("id"), "x", F.lit(0).alias("kind")))
    union = union.withColumn("is_step", 1 - F.col("kind"))
    # A step with the very value of a row counts for it; null ids come after all others.
    ranked = global_order(union.withColumn("no", F.coalesce(F.xxhash64("id"), F.lit(0))),
                          [("x", False), ("kind", True), ("no", True)], sums={"step": "is_step"}, rank_col=None)
    median = (ranked.filter("kind = 1").select("id", F.col("step").cast("long").alias("step"))
              .join(steps.select("step", "time"), "step", "left").select(F.col("id").alias("__id"), "time"))
    joined = out.join(median, out[id_col] == median["__id"], "left")
    return joined.withColumn("median_survival", F.coalesce("time", F.lit(float("inf")))).drop("__id", "time")


# ------------------------------------------------------------------ K6-K9

def concordance(df: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk") -> DataFrame:
    """K6: Harrell's C = P(risk_i > risk_j | T_i < T_j, event_i), ties in risk count 1/2.

    Exact and distributed by divide and conquer over the distinct durations: at level l
    the durations (dense rank k) are cut into blocks of 2^l; for every pair of sibling
    blocks (lower, upper) each event of the lower block counts the upper-block rows with
    smaller / equal risk through one prefix sum over (level, block pair, risk). Every pair of
    rows with different durations is counted at exactly one level; all levels are one pass over
    the (duration, risk) aggregate, exploded log2(#durations) times.
    """
    base = df.select(F.col(duration).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"),
                     F.col(risk).cast("double").alias("__r"))
    tk = global_order(base.select("__t").distinct(), [("__t", True)], rank_col="__k").withColumn("__k", F.col("__k") - 1)
    v = base.groupBy("__t", "__r").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__e") == 1).alias("e"))
    v = cut_lineage(v.join(tk, "__t"))
    last = v.agg(F.max("__k")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, int(last).bit_length() - 1)))
    # All levels in one pass: the level is part of the block's key.
    x = v.select("*", F.explode(levels).alias("__lv"))
    half = F.expr("shiftright(__k, __lv)")
    x = x.withColumn("__seg", F.concat_ws(":", "__lv", F.expr("shiftright(__k, __lv + 1)"))).withColumn("__up", half % 2 == 1)
    a = x.groupBy("__seg", "__r").agg(F.sum(F.when(F.col("__up"), F.col("n")).otherwise(0)).alias("un"),
                                      F.sum(F.when(~F.col("__up"), F.col("e")).otherwise(0)).alias("le"))
    o = global_order(a, [("__r", True)], partition_by=["__seg"], sums={"__cu": "un"}, rank_col=None)
    total = o.agg(F.sum(F.col("le") * (F.col("__cu") - F.col("un"))).alias("conc"),
                  F.sum(F.col("le") * F.col("un")).alias("ties"))
    agg = total.agg(F.sum("conc").alias("concordant_ordered_low"), F.sum("ties").alias("tied_risk"))
    # comparable pairs: events times rows with a larger duration
    tcnt = v.groupBy("__t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    tot_n = tcnt.agg(F.sum("n").alias("__N"))
    oc = global_order(tcnt, [("__t", True)], sums={"__cn": "n"}, rank_col=None).crossJoin(F.broadcast(tot_n))
    comp = oc.agg(F.sum(F.col("e") * (F.col("__N") - F.col("__cn"))).alias("comparable_pairs"))
    # the event (lower duration) should carry the HIGHER risk: count upper rows with lower risk
    return agg.crossJoin(comp).select(
        "comparable_pairs", F.col("concordant_ordered_low").alias("concordant_pairs"), "tied_risk",
        F.try_divide(F.col("concordant_ordered_low") + 0.5 * F.col("tied_risk"), F.col("comparable_pairs"))
        .alias("c_index"))


def survival_stats(surv: DataFrame, segment: str = "segment") -> DataFrame:
    """K7: totals, events, mean and median duration, event rate per segment."""
    from churnlens.functions.quantiles import grouped_quantiles
    g = surv.groupBy(segment).agg(F.count(F.lit(1)).alias("customers"), F.sum("event").alias("events"),
                                  F.avg("duration").alias("mean_duration"),
                                  F.avg(F.col("event").cast("double")).alias("event_rate"))
    med = grouped_quantiles(surv, "duration", [0.5], [segment]).select(segment, F.col("q").alias("median_duration"))
    return g.join(med, segment, "left")


def proxy_survival(pred: DataFrame) -> DataFrame:
    """K8: duration = max(1, 365 (1 - p)) rounded half to even, event = p >= .5."""
    p = F.col("churn_probability")
    return pred.withColumn("duration", F.bround(F.greatest(F.lit(1.0), 365 * (1 - p)), 0)) \
        .withColumn("event", (p >= 0.5).cast("int"))


def hazard_by_segment(curves: DataFrame, segment: str = "segment", time: str = "t",
                      surv: str = "survival") -> DataFrame:
    """K9: average hazard -ln(max(S_end / S_0, .001)) / t_max, and its yearly rate."""
    g = curves.groupBy(segment).agg(F.min_by(surv, time).alias("__s0"), F.max_by(surv, time).alias("__s1"),
                                    F.max(time).alias("__tmax"))
    ratio = F.greatest(F.try_divide(F.col("__s1"), F.col("__s0")), F.lit(0.001))
    hz = F.when(F.col("__tmax") > 0, -F.log(ratio) / F.col("__tmax")).otherwise(0.0)
    return g.select(segment, hz.alias("avg_daily_hazard"), (hz * 365).alias("annual_hazard"))
