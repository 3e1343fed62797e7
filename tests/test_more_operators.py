"""Row numbers, cell types, normal points, the AUC's interval and Firth's regression against brute force."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelab.models import evaluate, logistic
from valuelab.operators import celltypes, numbering


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_row_numbers(spark, partitions):
    rows = [(i % 5 if i % 11 else None, f"v{i % 3}", i, {"k": i}) for i in range(200)] + [(2, "v0", None, None)] * 50
    df = spark.createDataFrame(rows, "a int, b string, c int, m map<string,int>").repartition(3)
    got = numbering.row_numbers(df, ["a", "b"], partitions=partitions).orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(1, 251))
    keys = [(r.a is None, r.a or 0, r.b) for r in got]
    assert keys == sorted(keys)
    assert sorted((r.c or -1) for r in got) == sorted((r[2] or -1) for r in rows)
    down = numbering.row_numbers(df.where("c is not null"), [F.desc("c")], "n", partitions).collect()
    assert all(r.n == 200 - r.c for r in down)
    assert numbering.row_numbers(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        numbering.row_numbers(df, ["a"], "b")


def test_row_numbers_split_a_frequent_value(spark):
    df = spark.range(4000).selectExpr("1 as a", "id")
    numbered = numbering.row_numbers(df, ["a"], partitions=8)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert numbered.select("row_number").distinct().count() == 4000
    parts = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 2500


def test_cell_types(spark):
    cells = {
        "truth": ["true", " NO ", "Yes", None, ""],
        "whole": ["1", "-20", " +3 ", None, "  "],
        "real": ["1", "2.5", "4e+05", "-.5", None],
        "day": ["2024-01-31", "2024-2-9", None, "", "2023-12-01"],
        "stamp": ["2024-01-31 10:05", "2024-2-9T7:30", "2024-2-9 07:30:59", "2024-03-01", None],
        "words": ["a", "1", "2024-02-30", "2024-01-01 25:00", "1,000"],
        "none": [None, "", " ", None, None],
        "mixed": ["1", "2", "3", "x", "2.5"],
    }
    df = spark.createDataFrame(list(zip(range(5), *cells.values())), "id int, " + ", ".join(f"{c} string" for c in cells))
    got = {r.variable: tuple(r)[1:] for r in celltypes.guess_types(df).collect()}
    assert got == {
        "truth": ("boolean", 3, 3, 0),
        "whole": ("integer", 3, 3, 0),
        "real": ("number", 4, 4, 0),
        "day": ("date", 3, 3, 0),
        "stamp": ("timestamp", 4, 4, 0),
        "words": ("text", 5, 5, 0),
        "none": ("text", 0, 0, 0),
        "mixed": ("text", 5, 5, 0),
    }
    loose = {r.variable: tuple(r)[1:] for r in celltypes.guess_types(df, ["mixed"], 0.6).collect()}
    assert loose == {"mixed": ("integer", 5, 3, 2)}
    bad = celltypes.rejected_cells(df, ["id"], {"mixed": "number", "words": "date", "none": "integer", "stamp": "timestamp"})
    found = {(r.id, r.variable, r.cell, r.wanted) for r in bad.collect()}
    assert found == {(3, "mixed", "x", "number")} | {(i, "words", c, "date") for i, c in enumerate(cells["words"])}
    assert celltypes.guess_types(df.limit(0)).count() == 8 and celltypes.guess_types(df.select("id")).count() == 0
    with pytest.raises(ValueError):
        celltypes.rejected_cells(df, ["id"], {"mixed": "text"})


@pytest.mark.parametrize("n", [0, 1, 2, 57, 1000])
def test_normal_points(spark, n):
    values = np.random.default_rng(n).normal(3, 2, n)
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    got = evaluate.normal_points(spark.createDataFrame(rows, "e double"), "e", points=40).collect()
    assert len(got) == min(40, n)
    for r in got:
        assert abs(r.observed - np.sort(values)[r.rank - 1]) < 1e-9
        assert abs(r.expected - NormalDist().inv_cdf((r.rank - 0.5) / n)) < 1e-12
    assert [r.rank for r in got] == sorted({r.rank for r in got})


@pytest.mark.parametrize("options", [{}, {"splits": 8, "max_window_rows": 5}])
def test_auc_interval(spark, options):
    rng = np.random.default_rng(3)
    score = np.r_[rng.integers(0, 30, 200) / 10, rng.normal(2, 1, 100)]
    label = (rng.random(300) < 0.3 + 0.1 * (score > 2)).astype(int)
    pos, neg = score[label == 1], score[label == 0]
    won = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    error = math.sqrt(won.mean(1).var(ddof=1) / len(pos) + won.mean(0).var(ddof=1) / len(neg))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score)] + [(None, 1.0), (1, None)], "t int, s double")
    r = evaluate.auc_interval(df, "t", "s", **options).first()
    assert abs(r.auc - won.mean()) < 1e-12 and abs(r.std_error - error) < 1e-12
    assert abs(r.high - r.low - 2 * 1.959963984540054 * error) < 1e-9 and r.low < r.auc < r.high
    one = evaluate.auc_interval(df.where("t = 1"), "t", "s").first()
    assert one.auc is None and one.std_error is None and one.low is None
    few = evaluate.auc_interval(spark.createDataFrame([(1, 2.0), (0, 1.0), (0, 3.0)], "t int, s double"), "t", "s").first()
    assert few.auc == 0.5 and few.std_error is None


def brute_firth(X, y):
    """Newton's method on the modified score, leverages always at the estimates."""
    b = np.zeros(X.shape[1])
    for _ in range(500):
        p = 1 / (1 + np.exp(-X @ b))
        w = p * (1 - p)
        inv = np.linalg.inv((X * w[:, None]).T @ X)
        h = w * np.einsum("ij,jk,ik->i", X, inv, X)
        step = inv @ (X.T @ (y - p + h * (0.5 - p)))
        b = b + step / max(1.0, np.abs(step).max())
    return b, np.sqrt(np.diag(inv))


def test_firth_is_finite_on_separated_rows(spark):
    rng = np.random.default_rng(1)
    n = 120
    x = rng.normal(50, 1, n)
    g = rng.choice(["a", "b"], n)
    y = (x > 50.2).astype(int)  # x separates the classes
    rows = [(f"k{i}", float(a), b, int(c)) for i, (a, b, c) in enumerate(zip(x, g, y))]
    odd = [("o1", None, "a", 1), ("o2", 50.0, None, 1), ("o3", 50.0, "b", None), ("o4", 50.0, "c", None)]
    df = spark.createDataFrame(rows + odd, "k string, x double, g string, y int").withColumn("twice", F.col("x") * 2)
    fit = logistic.fit_firth(df, "y", ["g", "x", "twice"])
    assert fit.converged
    b, se = brute_firth(np.column_stack([np.ones(n), g == "b", x - 50]).astype(float), y)
    got = {r.term: r for r in fit.coefficients(df).collect()}
    assert list(got) == ["(Intercept)", "g_b", "x"]  # twice x adds nothing
    assert np.allclose([got["g_b"].estimate, got["x"].estimate], b[1:], rtol=1e-5)
    assert np.allclose([got["g_b"].std_error, got["x"].std_error], se[1:], rtol=1e-4)
    assert abs(got["(Intercept)"].estimate - (b[0] - 50 * b[2])) < 1e-3
    p = {r.k: r.probability for r in fit.score(df).collect()}
    assert p["k0"] is not None and p["o1"] is None and p["o2"] is None and 0 < p["o3"] < 1
    none = logistic.fit_firth(df.limit(0), "y", ["x"])
    assert [r.estimate for r in none.coefficients(df).collect()] == [0.0]


def test_guess_types_patterns_do_not_grow_with_the_columns(spark):
    rows = [("a ", "1"), ("a", "1"), (None, "2"), (" ", "1996-03-13"), ("true", " 7"), ("a", None)]
    wide = spark.createDataFrame(rows, "t string, m string")
    wider = wide.select(*[wide[c].alias(f"{c}{i}") for i in range(6) for c in ("t", "m")])

    def patterns(df):
        plan = celltypes.guess_types(df, least_share=0.7)._jdf.queryExecution().optimizedPlan().toString()
        return plan.lower().count("rlike")

    assert patterns(wider) == patterns(wide)
    found = [tuple(r) for r in celltypes.guess_types(wider, least_share=0.7).collect()]
    t, m = ("text", 4, 4, 0), ("integer", 5, 4, 1)
    assert found == [(f"{c}{i}", *told) for i in range(6) for c, told in (("t", t), ("m", m))]
