"""Cox fit on the executors against a direct Efron fit; predictions against a step lookup."""
import math

import numpy as np

from churnlens.operators import survival as sv


def direct_efron(x, t, e, penalizer, steps=40):
    """Newton steps on standardised columns, risk sets by masks."""
    sd, mean = x.std(0, ddof=1), x.mean(0)
    z, beta = (x - mean) / sd, np.zeros(x.shape[1])
    for _ in range(steps):
        w, g, h = np.exp(z @ beta), -penalizer * beta, -penalizer * np.eye(len(beta))
        for time in np.unique(t[e == 1]):
            risk, tied = t >= time, (t == time) & (e == 1)
            d = tied.sum()
            g = g + z[tied].sum(0)
            for k in range(d):
                a = w * risk - k / d * w * tied
                m = a @ z / a.sum()
                g = g - m
                h = h - ((z * a[:, None]).T @ z / a.sum() - np.outer(m, m))
        beta = beta - np.linalg.solve(h, g)
    return beta / sd, beta, mean, sd


def frame(n=220, seed=4):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.normal(2, 3, size=n)], 1)
    t = np.ceil(rng.exponential(8 / np.exp(0.5 * x[:, 0] - 0.1 * x[:, 1]))).clip(1, 20)
    return x, t, (rng.random(n) < 0.7).astype(int)


def test_coefficients_match_a_direct_fit(spark):
    x, t, e = frame()
    df = spark.createDataFrame([(i, *map(float, x[i]), float(t[i]), int(e[i])) for i in range(len(t))],
                               "customer_id long, a double, b double, duration double, event int")
    model = sv.fit_cox(df, ["a", "b"], penalizer=0.01)
    coef, beta, mean, sd = direct_efron(x, t, e, 0.01)
    assert np.allclose(model["coef"], coef, atol=1e-6) and np.allclose(model["gradient"], 0, atol=1e-6)

    hazard = np.exp((x - mean) / sd @ beta)
    times = np.unique(t)
    h0 = np.cumsum([e[t == s].sum() / hazard[t >= s].sum() for s in times])
    got = {r["time"]: r["cum_hazard"] for r in model["baseline"].collect()}
    assert np.allclose([got[s] for s in times], h0)
    rows = {r["customer_id"]: r for r in sv.cox_predict(df, model, (0.5, 5.0, 99.0)).collect()}
    assert len(rows) == len(t)
    for i in range(len(t)):
        below = np.flatnonzero(np.exp(-h0 * hazard[i]) <= 0.5)
        assert rows[i]["median_survival"] == (times[below[0]] if len(below) else math.inf)
        for at, name in ((0.5, "survival_0"), (5.0, "survival_5"), (99.0, "survival_99")):
            k = max(int(np.searchsorted(times, at, side="right")) - 1, 0)
            assert abs(rows[i][name] - math.exp(-h0[k] * hazard[i])) < 1e-9


def test_many_ties_are_split_into_blocks(spark, monkeypatch):
    x, t, e = frame(150, 7)
    t = np.minimum(t, 3)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(t[i]), int(e[i])) for i in range(len(t))],
                               "customer_id long, a double, b double, duration double, event int")
    monkeypatch.setattr(sv, "TIE_BLOCK", 7)
    assert np.allclose(sv.fit_cox(df, ["a", "b"])["coef"], direct_efron(x, t, e, 0.01)[0], atol=1e-6)


def fit(spark, rows, features, **options):
    return sv.fit_cox(spark.createDataFrame(rows, "a double, b double, duration double, event int"), features, **options)


def test_likelihood_never_falls_and_convergence_is_told(spark):
    x, t, e = frame(120, 9)
    rows = [(float(20 * x[i, 0] ** 3), float(x[i, 1]), float(t[i]), int(e[i])) for i in range(len(t))]
    m = fit(spark, rows, ["a", "b"], penalizer=1e-6)
    path = m["likelihood_path"]
    assert m["converged"] and all(b > a for a, b in zip(path, path[1:])) and np.allclose(m["gradient"], 0, atol=1e-5)
    assert np.allclose(m["coef"], direct_efron(np.array([r[:2] for r in rows]), t, e, 1e-6)[0], atol=1e-6)
    assert not fit(spark, rows, ["a", "b"], max_iter=1)["converged"]


def test_separated_groups_do_not_converge_without_a_penalty(spark):
    # Every row of a = 1 dies before any of a = 0: the likelihood rises for ever.
    rows = [(1.0, 0.0, float(i + 1), 1) for i in range(12)] + [(0.0, 0.0, float(i + 20), 1) for i in range(12)]
    m = fit(spark, rows, ["a"], penalizer=0.0)
    path = m["likelihood_path"]
    assert not m["converged"] and all(b > a for a, b in zip(path, path[1:]))
    assert np.isfinite(m["log_likelihood"]) and np.isfinite(m["coef"][0])
    assert fit(spark, rows, ["a"], penalizer=0.1)["converged"]


def test_constant_feature_and_large_predictors(spark):
    x, t, e = frame(80, 2)
    rows = [(5.0, float(x[i, 1]), float(t[i]), int(e[i])) for i in range(len(t))]
    m = fit(spark, rows, ["a", "b"], penalizer=0.0)
    assert m["coef"][0] == 0 and m["converged"]
    assert np.allclose(m["coef"][1], direct_efron(np.array([[r[1]] for r in rows]), t, e, 0.0)[0], atol=1e-6)
    # Weights of exp(1000) overflow without the shift.
    base = spark.createDataFrame([(float(a), 1.0 + i, 1) for i, a in enumerate([1000, 990, 995, 980])], "__z0 double, __t double, __e int")
    ll, g, h = sv._cox_step(base, np.array([1.0]), 0.0)
    eta = np.array([1000.0, 990, 995, 980])
    want = sum(eta[i] - (eta[i:].max() + np.log(np.exp(eta[i:] - eta[i:].max()).sum())) for i in range(4))
    assert abs(ll - want) < 1e-9 and np.isfinite(g).all() and np.isfinite(h).all()
