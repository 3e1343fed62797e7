"""Cross products from level codes, fits on coded rows and shared tree encodings, against dense NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from valuelab.models import linear, logistic, moments, pruning, tree
from valuelab.operators import split


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    a, b = rng.choice(["p", "q", "r"], n), rng.choice(["u", "v"], n)
    x = rng.normal(4, 1, n)
    y = 2 * (a == "q") + (b == "v") + x + rng.normal(0, 0.5 + 0.3 * (b == "v"), n)
    rows = [(f"k{i}", *v) for i, v in enumerate(zip(a.tolist(), b.tolist(), x.tolist(), y.tolist()))]
    df = spark.createDataFrame(rows + [("o1", None, "u", 1.0, 1.0), ("o2", "p", "v", None, 1.0)], "k string, a string, b string, x double, y double")
    dense = np.column_stack([np.ones(n), a == "r", a == "q", b == "v", x]).astype(float)
    return df.repartition(3).cache(), dense, y


def test_products_and_forms_need_no_dense_rows():
    rng = np.random.default_rng(0)
    n = 50
    code = moments.Coding("y", (("a", ("r", "q", "p")), ("x", None), ("b", ("v", "u"))), (0.0, 0.0, 0.0, 1.5, 0.0, 2.0))
    a, b, x, y = rng.choice(["p", "q", "r", "new"], n), rng.choice(["u", "v"], n), rng.normal(size=n), rng.normal(size=n)
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(x), pa.array(b), pa.array(y)], names=["a", "x", "b", "y"])
    rows, kept = code.rows(batch)
    assert kept.tolist() == np.flatnonzero(a != "new").tolist()
    z = np.column_stack([np.ones(n), a == "r", a == "q", x - 1.5, b == "v", y - 2.0]).astype(float)[kept]
    w = rng.random(len(kept))
    assert np.allclose(rows.products(), z.T @ z) and np.allclose(rows.products(w), z.T @ (z * w[:, None]))
    assert np.allclose(rows.sums(w), z.T @ w) and np.allclose(rows.dot(np.arange(6.0)), z @ np.arange(6.0))
    form = z.T @ z
    assert np.allclose(rows.form(form), np.einsum("ij,jk,ik->i", z, form, z))
    more = rows.widened([w, w * w])
    wide = np.column_stack([z[:, :-1], w, w * w, z[:, -1]])
    assert np.allclose(more.products(), wide.T @ wide)


def test_breusch_pagan_and_cook_from_moments(spark, data):
    df, X, y = data
    found = moments.collect_moments(df, linear.fit_design(df, ["a", "b", "x"]), "y")
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    e2 = e**2
    left = e2 - X @ np.linalg.lstsq(X, e2, rcond=None)[0]
    told = moments.breusch_pagan(df, found).first()
    assert told["n"] == 600 and told["df"] == 4
    assert abs(told["statistic"] - 600 * (1 - (left**2).sum() / ((e2 - e2.mean()) ** 2).sum())) < 1e-6
    h = np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ X), X)
    cook = e2 / (5 * (e2.sum() / 595)) * h / (1 - h) ** 2
    got = {r["k"]: r for r in moments.cooks_distance(df, found, "k").collect()}
    assert len(got) == 600
    assert np.allclose([got[f"k{i}"]["leverage"] for i in range(600)], h)
    assert np.allclose([got[f"k{i}"]["cooks_d"] for i in range(600)], cook)


def test_fits_read_coded_rows(spark, data, monkeypatch):
    df, X, y = data
    rows = df.withColumn("hit", (F.col("y") > float(np.median(y))).cast("int"))
    kinds = []
    summed = moments.summed
    monkeypatch.setattr(moments, "summed", lambda d, *rest: kinds.append(dict(d.dtypes)["a"]) or summed(d, *rest))
    logit, firth = (f(rows, "hit", ["a", "b", "x"]) for f in (logistic.fit_logit, logistic.fit_firth))
    assert set(kinds) == {"int"} and logit.converged and firth.converged
    t, beta = (y > np.median(y)).astype(float), np.zeros(5)
    for _ in range(40):
        p = 1 / (1 + np.exp(-X @ beta))
        cov = np.linalg.inv((X * (p * (1 - p))[:, None]).T @ X)
        beta = beta + cov @ X.T @ (t - p)
    got = {r["term"]: r for r in logit.coefficients(df).collect()}
    terms = ["(Intercept)", *logit.design.names]
    assert np.allclose([got[k]["estimate"] for k in terms], beta, rtol=1e-5)
    assert np.allclose([got[k]["std_error"] for k in terms], np.sqrt(np.diag(cov)), rtol=1e-4)


def test_predictions_equal_the_expressions(spark, data):
    df, *_ = data
    fits = linear.nested_fits(df.withColumn("dataset", F.lit("Train")), "y", [["a"], ["b", "x"]])
    odd = df.unionByName(spark.createDataFrame([("o3", "new", "u", 1.0, 1.0)], df.schema))
    got = {r["k"]: r for r in moments.predictions(odd, {"one": fits[0], "two": fits[1]}, ["k", "y"]).collect()}
    want = odd.where(fits[0].design.scorable()).select("k", fits[0].predict().alias("one"), fits[1].predict().alias("two")).collect()
    assert set(got) == {r["k"] for r in want} and len(got) == 600
    assert all(abs(got[r["k"]][c] - r[c]) < 1e-9 for r in want for c in ("one", "two"))


def test_folds_share_one_encoding(spark, data, monkeypatch):
    df, *_ = data
    calls = []
    encode = tree.encode
    for module in (tree, pruning):
        monkeypatch.setattr(module, "encode", lambda *a: calls.append(1) or encode(*a))
    whole = pruning.validated_tree(df, "y", ["a", "b", "x"], "k", max_depth=3, min_rows=20)
    assert len(calls) == 1 and len(whole.cv_error) == len(whole.sequence)
    calls.clear()
    rare = df.unionByName(spark.createDataFrame([("r1", "rare", "u", 1.0, 1.0)], df.schema))
    pruning.validated_tree(rare, "y", ["a", "b", "x"], "k", max_depth=3, min_rows=20)
    assert len(calls) == 2  # the fold that holds the only such row is encoded anew


def test_side_finds_the_hash_once(spark):
    df = spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 97).cast("double").alias("y"))
    rule = split.fit_split(df, "k", "y")
    assert str(rule.side()).lower().count("md5") == 1
    counts = {r["dataset"]: r["count"] for r in rule.apply(df).groupBy("dataset").count().collect()}
    assert counts["Train"] == sum(need for _, need in rule.sizes.values()) and sum(counts.values()) == 400


def test_wide_rows_pass_in_packed_cells(spark):
    rng = np.random.default_rng(8)
    n = 700
    names = [f"x{i}" for i in range(7)]
    x, a = rng.normal(size=(n, 7)), rng.choice(["p", "q", "r"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] - (a == "q")))).astype(int)
    rows = [(*u, v, w) for u, v, w in zip(x.tolist(), a.tolist(), y.tolist())]
    rows += [(None, *[0.0] * 6, "p", 1), (*[0.0] * 7, None, 1), (float("nan"), *[0.0] * 6, "p", 0), (*[0.0] * 7, "p", None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", a string, y int").repartition(3)
    design = linear.fit_design(df, [*names, "a"])
    code = moments.coding(df, design, "y")
    cells = moments.coded(df, code)
    assert cells.dtypes == [("__rows", "binary")] and cells.count() < n / 10
    assert np.allclose(moments.products(cells, code), moments.products(df, code))
    dense = np.column_stack([np.ones(n), x, a == "r", a == "q"]).astype(float)
    logit, firth = (f(df, "y", [*names, "a"]) for f in (logistic.fit_logit, logistic.fit_firth))
    for fit, bias in ((logit, 0.0), (firth, 0.5)):
        beta = np.zeros(dense.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-dense @ beta))
            cov = np.linalg.inv((dense * (p * (1 - p))[:, None]).T @ dense)
            h = p * (1 - p) * np.einsum("ij,jk,ik->i", dense, cov, dense)
            beta = beta + cov @ dense.T @ (y - p + 2 * bias * h * (0.5 - p))
        got = {r["term"]: r["estimate"] for r in fit.coefficients(df).collect()}
        assert fit.converged and np.allclose([got[t] for t in ["(Intercept)", *fit.design.names]], beta, atol=1e-6)


def test_open_prefixes_find_the_hash_once(spark):
    df = spark.createDataFrame([(1, "ab1"), (1, "cd1"), (3, "cd2"), (2, "ab2"), (4, "cd"), (None, "ab")], "b int, h string")
    kept = split._in_open_prefix({1: ("ab", 1, 1), 3: ("cd", 1, 1)})
    assert str(kept).count("startswith") == 1
    assert [r["h"] for r in df.where(kept).collect()] == ["ab1", "cd2"]
    assert df.where(split._in_open_prefix({})).count() == 0
