"""Models and metrics against NumPy and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelab.functions import distributions
from valuelab.models import evaluate, linear, logistic, tree


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 900
    seg = rng.choice(["a", "b", "c"], n)
    x = rng.normal(5, 2, n)
    z = x * 0.8 + rng.normal(0, 1, n)
    y = 10 + 3 * (seg == "b") - 2 * (seg == "c") + 1.5 * x + rng.normal(0, 1 + 0.2 * np.abs(x), n)
    side = np.where(np.arange(n) % 5 == 0, "Test", "Train")
    rows = [(f"k{i}", s, float(a), float(b), float(c), d) for i, (s, a, b, c, d) in enumerate(zip(seg, x, z, y, side))]
    df = spark.createDataFrame(rows, "k string, seg string, x double, z double, y double, dataset string")
    matrix = np.column_stack([np.ones(n), seg == "c", seg == "b", x, z]).astype(float)
    return df.cache(), matrix, y, side == "Train"


PREDICTORS = ["seg", "x", "z"]


def ols(X, y):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    s2 = (e**2).sum() / (len(y) - X.shape[1])
    return b, e, s2, np.linalg.inv(X.T @ X)


def test_coefficients_and_diagnostics(spark, data):
    df, X, y, train = data
    rows = df.where("dataset = 'Train'")
    design = linear.fit_design(rows, PREDICTORS)
    assert design.names == ["seg_c", "seg_b", "x", "z"]  # the first level has no column
    encoded = design.apply(rows)
    model = linear.fit_line(encoded, "y")
    b, e, s2, inv = ols(X[train], y[train])
    table = {r["term"]: r for r in linear.coefficients(df, model, design.names).collect()}
    terms = ["(Intercept)", *design.names]
    assert np.allclose([table[t]["estimate"] for t in terms], b, rtol=1e-6)
    assert np.allclose([table[t]["std_error"] for t in terms], np.sqrt(np.diag(inv) * s2), rtol=1e-6)

    scored = model.transform(encoded)
    cook = {r["k"]: r for r in linear.cooks_distance(scored, "k", "y").collect()}
    h = np.einsum("ij,jk,ik->i", X[train], inv, X[train])
    d = e**2 / (5 * s2) * h / (1 - h) ** 2
    keys = [f"k{i}" for i in np.flatnonzero(train)]
    assert np.allclose([cook[k]["leverage"] for k in keys], h, rtol=1e-6)
    assert np.allclose([cook[k]["cooks_d"] for k in keys], d, rtol=1e-5)

    vif = {r["term"]: r["vif"] for r in linear.inflation_factors(scored, design.names).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(X[train][:, 1:].T)))
    assert np.allclose([vif[t] for t in design.names], want, rtol=1e-6)

    bp = linear.breusch_pagan(scored, "y").first()
    e2 = e**2
    fit = X[train] @ np.linalg.lstsq(X[train], e2, rcond=None)[0]
    r2 = 1 - ((e2 - fit) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert abs(bp["statistic"] - len(e) * r2) < 1e-6 and bp["df"] == len(e) - (len(e) - 5) - 1
    assert 0 <= bp["p_value"] < 0.05


def test_nested_steps(spark, data):
    df, X, y, train = data
    steps = linear.nested_regressions(df, "y", [["seg"], ["x"], ["z"]]).collect()
    for r, k in zip(steps, (3, 4, 5)):
        b, e, *_ = ols(X[train][:, :k], y[train])
        r2 = 1 - (e**2).sum() / ((y[train] - y[train].mean()) ** 2).sum()
        n = train.sum()
        away = y[~train] - X[~train][:, :k] @ b
        assert r["n_terms"] == k - 1 and r["n_train"] == n
        assert abs(r["r2_train"] - r2) < 1e-8
        assert abs(r["adj_r2_train"] - (1 - (1 - r2) * (n - 1) / (n - k))) < 1e-8
        assert abs(r["rmse_test"] - math.sqrt((away**2).mean())) < 1e-6
        assert abs(r["mae_test"] - np.abs(away).mean()) < 1e-6
    assert steps[0]["adj_r2_gain"] is None
    frame = spark.createDataFrame(steps)
    assert linear.choose_step(frame, 0.01) == 2
    assert linear.choose_step(frame, 2.0) == 1


def test_unseen_levels_are_left_out(spark, data):
    df, *_ = data
    design = linear.fit_design(df.where("seg <> 'c'"), PREDICTORS)
    assert design.apply(df).count() == df.where("seg <> 'c'").count()


def test_logit(spark, data):
    df, X, y, train = data
    cut = evaluate.high_value_threshold(df.where("dataset = 'Train'"), "y")
    assert abs(cut - np.quantile(y[train], 0.8)) < 1e-9
    rows = evaluate.label_high_value(df, "y", cut)
    fit = logistic.fit_logit(rows.where("dataset = 'Train'"), "high_value", PREDICTORS)
    b, t = np.zeros(5), (y[train] >= cut).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X[train] @ b))
        cov = np.linalg.inv((X[train] * (p * (1 - p))[:, None]).T @ X[train])
        b = b + cov @ X[train].T @ (t - p)
    table = fit.coefficients(df)
    got = {r["term"]: r for r in table.collect()}
    terms = ["(Intercept)", *fit.design.names]
    assert np.allclose([got[k]["estimate"] for k in terms], b, rtol=1e-4)
    assert np.allclose([got[k]["std_error"] for k in terms], np.sqrt(np.diag(cov)), rtol=1e-3)
    odds = {r["term"]: r for r in logistic.odds_ratios(table).collect()}
    assert abs(odds["x"]["odds_ratio"] - math.exp(b[3])) < 1e-3
    assert odds["x"]["low"] < odds["x"]["odds_ratio"] < odds["x"]["high"]
    ranked = evaluate.score_ranking(fit.score(rows), "k", "probability").collect()
    p = [r["probability"] for r in ranked]
    assert p == sorted(p, reverse=True) and len(p) == 900


def test_tree_segments(spark, data):
    df, _, y, train = data
    fit = tree.fit_tree(df.where("dataset = 'Train'"), "y", PREDICTORS, max_depth=3, min_rows=20)
    out = tree.tree_segments(fit, df, "y").collect()
    assert sum(r["n_train"] for r in out) == train.sum()
    assert sum(r["n_test"] for r in out) == (~train).sum()
    assert len(fit.rules()) == len(out)
    # Each rule, applied as a filter, selects the rows of its leaf.
    for r in out:
        where = r["rule"].replace("{", "('").replace("}", "')").replace(", ", "', '")
        assert df.where(where).where("dataset = 'Train'").count() == r["n_train"]
        assert abs(df.where(where).where("dataset = 'Train'").agg(F.avg("y")).first()[0] - r["mean_train"]) < 1e-9


def test_rules_of_a_single_leaf():
    assert tree.leaf_rules("Model: depth=0\n  Predict: 3.0\n", ["x"], {}) == ["all"]


def auc(label, score):
    pos = [s for t, s in zip(label, score) if t]
    neg = [s for t, s in zip(label, score) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("options", [{}, {"splits": 8, "max_window_rows": 5}, {"splits": 4, "max_window_rows": 500}])
def test_auc_counts_ties_half(spark, options):
    rng = np.random.default_rng(3)
    score = np.concatenate([rng.integers(0, 40, 300) / 10, rng.normal(2, 1, 300), [9.0] * 50])
    label = (rng.random(650) < 0.3 + 0.1 * (score > 2)).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score)], "t int, s double")
    row = evaluate.roc_auc(df, "t", "s", **options).first()
    assert abs(row["auc"] - auc(label, score)) < 1e-12
    assert (row["n_positive"], row["n_negative"]) == (label.sum(), 650 - label.sum())


def test_auc_degenerate(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "t int, s double")
    assert evaluate.roc_auc(one, "t", "s").first()["auc"] is None
    perfect = spark.createDataFrame([(0, 0.2), (1, 0.4)], "t int, s double")
    assert evaluate.roc_auc(perfect, "t", "s").first()["auc"] == 1.0
    assert evaluate.roc_auc(one.limit(0), "t", "s").first()["auc"] is None


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.1), (0, 0.2), (0, 0.3)], "t int, s double")
    r = evaluate.classification_metrics(df, "t", "s").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2)
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.6, 0.5, 0.5, 0.5)
    none = evaluate.classification_metrics(df.where("t = 0"), "t", "s", 2.0).first()
    assert none["precision"] is None and none["recall"] is None


def test_residual_bins(spark):
    df = spark.createDataFrame([(float(i), float(i) + (i % 3)) for i in range(50)], "p double, y double")
    out = evaluate.residual_bins(df, "y", "p", 5).collect()
    assert sum(r["n"] for r in out) == 50 and {r["bin"] for r in out} == set(range(5))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "p double, y double")
    assert evaluate.residual_bins(flat, "y", "p").first()["mean_residual"] == 2.0


def test_tail_probabilities():
    # Fixed values from printed tables.
    assert abs(distributions.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert abs(distributions.t_quantile(0.975, 1000) - 1.962339) < 1e-5
    assert abs(distributions.chi2_tail(3.841459, 1) - 0.05) < 1e-6
    assert abs(distributions.chi2_tail(18.307038, 10) - 0.05) < 1e-6
    assert distributions.chi2_tail(0, 3) == 1.0
