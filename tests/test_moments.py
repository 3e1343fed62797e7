"""Fits, tests and diagnostics from cross products against NumPy on whole matrices."""

import math

import numpy as np
import pytest

from valuelab.functions import distributions
from valuelab.models import linear, moments

PREDICTORS = ["seg", "x", "z"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 700
    seg = rng.choice(["a", "b", "c"], n)
    x = rng.normal(1e5, 2, n)
    z = (x - 1e5) * 0.8 + rng.normal(0, 1, n)
    y = 1e6 + 3 * (seg == "b") - 2 * (seg == "c") + 1.5 * (x - 1e5) ** 2 + rng.normal(0, 1 + np.abs(z), n)
    rows = [(f"k{i}", s, float(a), float(b), float(c)) for i, (s, a, b, c) in enumerate(zip(seg, x, z, y))]
    odd = [("o1", None, 1.0, 1.0, 1.0), ("o2", "a", None, 1.0, 1.0), ("o3", "a", float("nan"), 1.0, 1.0), ("o4", "b", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "k string, seg string, x double, z double, y double")
    X = np.column_stack([np.ones(n), seg == "c", seg == "b", x - 1e5, z]).astype(float)
    return df.repartition(3).cache(), X, y


def collected(df, predictors=PREDICTORS):
    return moments.collect_moments(df, linear.fit_design(df, predictors), "y")


def ols(X, y):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    return b, e, np.linalg.inv(X.T @ X)


def f_share(f, d1, d2, steps=200_000):
    """P(F > f) by the midpoint rule on t = d1 x / (d1 x + d2)."""
    low = d1 * f / (d1 * f + d2)
    t = low + (np.arange(steps) + 0.5) * (1 - low) / steps
    logs = (d1 / 2 - 1) * np.log(t) + (d2 / 2 - 1) * np.log1p(-t)
    front = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)
    return float(np.exp(logs + front).sum() * (1 - low) / steps)


def test_tails():
    for f, d1, d2 in ((0.5, 2, 10), (3.3, 4, 30), (2.0, 3, 600), (1.0, 2, 2), (9.0, 7, 40)):
        assert abs(distributions.f_tail(f, d1, d2) - f_share(f, d1, d2)) < 1e-6
    assert abs(distributions.f_tail(4.964603, 1, 10) - 0.05) < 1e-6  # a printed table
    assert abs(distributions.t_tail_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert distributions.f_tail(0.0, 2, 5) == 1.0 and distributions.beta_share(1.0, 2, 3) == 1.0


def test_sweep_inverts():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(9, 5))
    a = a.T @ a
    b = a.copy()
    for k in (3, 0, 4, 1, 2):
        moments.sweep(b, k)
    assert np.allclose(b, np.linalg.inv(a), rtol=1e-8)


def test_all_fits_from_one_pass(data):
    df, X, y = data
    m = collected(df)
    assert m.n == len(y)
    fits = m.fits([[0, 1], [2], [3]])
    for fit, k in zip(fits, (3, 4, 5)):
        b, e, _ = ols(X[:, :k], y)
        assert np.allclose(fit.slopes[: k - 1], b[1:], rtol=1e-8) and not fit.slopes[k - 1 :].any()
        assert abs(fit.sse / (e @ e) - 1) < 1e-9
    b1, e1, _ = ols(X[:, :3], y)
    b2, e2, _ = ols(X[:, :4], y)
    f, d1, d2, p = moments.partial_f(fits[0], fits[1])
    want = (e1 @ e1 - e2 @ e2) / (e2 @ e2 / (len(y) - 4))
    assert (d1, d2) == (1, len(y) - 4) and abs(f / want - 1) < 1e-7
    assert abs(p - f_share(f, d1, d2)) < 1e-5
    scored = df.select("k", fits[2].predict().alias("p")).collect()
    got = {r["k"]: r["p"] for r in scored}
    fitted = X @ ols(X, y)[0]
    assert np.allclose([got[f"k{i}"] for i in range(len(y))], fitted, rtol=1e-10)
    assert [got[k] for k in ("o1", "o2", "o3")] == [None] * 3 and got["o4"] is not None


def test_columns_that_add_nothing_are_passed_over(spark, data):
    df, X, y = data
    wide = df.where("k like 'k%'").selectExpr("k", "seg", "x", "z", "2 * x - 3 as w", "7 as one", "y")
    m = collected(wide, ["x", "w", "one", "z"])
    fits = m.fits([[0, 1], [2, 3]])
    assert fits[0].used == (0,) and fits[1].used == (0, 3)
    b, e, _ = ols(X[:, [0, 3, 4]], y)
    assert abs(fits[1].sse / (e @ e) - 1) < 1e-8
    assert moments.partial_f(fits[0], fits[0])[0] is None
    empty = collected(df.limit(0), ["x"])
    assert empty.n == 0 and empty.fit().used == ()
    assert moments.partial_f(None, empty.fit())[3] is None


@pytest.mark.parametrize("kind", ["HC0", "HC1", "HC2", "HC3"])
def test_robust_errors(data, kind):
    df, X, y = data
    b, e, inv = ols(X, y)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    w = {"HC0": e**2, "HC1": e**2 * len(y) / (len(y) - 5), "HC2": e**2 / (1 - h), "HC3": (e / (1 - h)) ** 2}[kind]
    cov = inv @ (X * w[:, None]).T @ X @ inv
    got = {r["term"]: r for r in moments.robust_coefficients(df, collected(df), kind).collect()}
    assert list(got) == ["(Intercept)", "seg_c", "seg_b", "x", "z"]
    terms = ["seg_c", "seg_b", "x", "z"]
    assert np.allclose([got[t]["estimate"] for t in terms], b[1:], rtol=1e-7)
    assert np.allclose([got[t]["robust_error"] for t in terms], np.sqrt(np.diag(cov))[1:], rtol=1e-6)
    usual = np.sqrt(np.diag(inv) * (e @ e) / (len(y) - 5))
    assert np.allclose([got[t]["std_error"] for t in terms], usual[1:], rtol=1e-6)
    # the intercept belongs to x as it is, not to x - 1e5
    T = np.eye(5)
    T[0, 3] = -1e5
    assert abs(got["(Intercept)"]["estimate"] / (T @ b)[0] - 1) < 1e-8
    assert abs(got["(Intercept)"]["robust_error"] / math.sqrt((T @ cov @ T.T)[0, 0]) - 1) < 1e-6
    t = got["z"]["robust_t"]
    assert abs(got["z"]["robust_p"] - f_share(t * t, 1, len(y) - 5)) < 2e-3


def test_reset_sees_the_bend(spark, data):
    df, X, y = data
    b, e, _ = ols(X, y)
    fitted = X @ b
    u = (fitted - fitted.mean()) / fitted.std()
    _, wide, _ = ols(np.column_stack([X, u**2, u**3]), y)
    want = (e @ e - wide @ wide) / 2 / (wide @ wide / (len(y) - 7))
    r = moments.reset_test(df, collected(df)).first()
    assert (r.n, r.df1, r.df2) == (len(y), 2, len(y) - 7) and abs(r.f_value / want - 1) < 1e-6
    straight = df.selectExpr("x", "3 * x + 100 * (abs(hash(k)) % 1000) / 1000 as y")
    flat = moments.reset_test(straight, collected(straight, ["x"])).first()
    assert flat.p_value > 0.001 and 0 <= r.p_value < 0.05


@pytest.mark.parametrize("centred", [False, True])
def test_collinearity(data, centred):
    df, X, _ = data
    full = X + np.array([0, 0, 0, 1e5, 0]) if not centred else (X - X.mean(0))[:, 1:]
    own = full / np.linalg.norm(full, axis=0)
    _, s, vt = np.linalg.svd(own, full_matrices=False)
    part = (vt.T / s) ** 2
    share = part / part.sum(axis=1, keepdims=True)
    names = ["(Intercept)", "seg_c", "seg_b", "x", "z"][centred:]
    got = moments.collinearity(df, collected(df), centred).collect()
    by = {(r.component, r.term): r for r in got}
    tolerance = 1e-6 if centred else 2e-2  # x about 1e5 is nearly the intercept
    for j in range(len(names)):
        assert abs(by[j + 1, names[0]].condition_index / (s[0] / s[j]) - 1) < tolerance
        for i, name in enumerate(names):
            assert abs(by[j + 1, name].share - share[i, j]) < tolerance
