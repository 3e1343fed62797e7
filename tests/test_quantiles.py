"""Exact quantiles against NumPy, on the paths that small data would not take by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelab.operators.quantiles import quantile_summary, quantiles_long

PROBS = [0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0]


def frame(spark, seed=1, n=6000):
    rng = np.random.default_rng(seed)
    group = rng.choice(["hot", "a", "b", None], n, p=[0.7, 0.2, 0.05, 0.05])
    x = np.where(rng.random(n) < 0.3, 5.0, rng.lognormal(3, 2, n))
    rows = [
        (g, None if rng.random() < 0.1 else float(v), float(i % 17)) for i, (g, v) in enumerate(zip(group, x))
    ]
    rows += [("empty", None, None), ("one", 3.5, 1.0), ("nan", float("nan"), 2.0)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(5), rows


def expected(rows, column):
    groups = {}
    for r in rows:
        v = r[column]
        groups.setdefault(r[0], [])
        if v is not None and v == v:
            groups[r[0]].append(v)
    return {g: (list(np.quantile(v, PROBS)) if v else [None] * len(PROBS)) for g, v in groups.items()}


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"accuracy": 100},
        {"accuracy": 100, "max_window_rows": 3},
        {"accuracy": 200, "max_groups": 2},
    ],
)
def test_grouped(spark, options):
    df, rows = frame(spark)
    out = quantile_summary(df, ["x", "y"], PROBS, ["g"], [("n", F.count(F.lit(1)))], **options).collect()
    assert out[0].__fields__[:2] == ["g", "n"]
    want_x, want_y = expected(rows, 1), expected(rows, 2)
    assert {r["g"] for r in out} == set(want_x)
    for r in out:
        for column, want in (("x", want_x), ("y", want_y)):
            got = [r[f"{column}_p{round(p * 100)}"] for p in PROBS]
            assert [v is None for v in got] == [v is None for v in want[r["g"]]]
            if got[0] is not None:
                assert np.allclose(got, want[r["g"]], rtol=1e-12)
        assert r["n"] == sum(1 for row in rows if row[0] == r["g"])


@pytest.mark.parametrize("options", [{}, {"accuracy": 100, "max_window_rows": 5}])
def test_whole_table(spark, options):
    df, rows = frame(spark, seed=2)
    got = quantile_summary(df, ["x"], PROBS, extra=[("top", F.max("y")), ("low", F.min("g"))], **options).first()
    want = np.quantile([r[1] for r in rows if r[1] is not None and r[1] == r[1]], PROBS)
    assert np.allclose([got[f"x_p{round(p * 100)}"] for p in PROBS], want, rtol=1e-12)
    assert got["top"] == 16.0 and got["low"] == "a"


def test_empty_and_negative(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert tuple(quantile_summary(none, ["x"], [0.5]).first()) == (None,)
    assert quantile_summary(none, ["x"], [0.5], ["g"]).collect() == []
    df = spark.createDataFrame([(-5.0,), (-1e-7,), (float("-inf"),), (2.0,)], "x double")
    assert quantile_summary(df, ["x"], [0.0, 1.0]).first()["x_p0"] == float("-inf")


def test_long_form_and_sketch(spark):
    df, rows = frame(spark, seed=3)
    out = {r["p"]: r["value"] for r in quantiles_long(df, "y", [0.25, 0.8]).collect()}
    y = [r[2] for r in rows if r[2] is not None]
    assert out == {0.25: np.quantile(y, 0.25), 0.8: np.quantile(y, 0.8)}
    near = quantile_summary(df, ["x"], [0.5], approximate=True).first()["x_p50"]
    x = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])
    assert abs(np.searchsorted(x, near) - len(x) / 2) < len(x) * 0.3
