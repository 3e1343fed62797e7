"""Split sizes, stability and leakage; imputation and levels."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelab import plans
from valuelab.operators import impute, split


def targets(spark, n=1003, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(f"k{i}", float(rng.integers(1, 400))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, y double").repartition(4), rows


def brute_force(rows, share=0.8, seed=123):
    y = np.array([r[1] for r in rows])
    edges = sorted({e for e in np.quantile(y, [0.25, 0.5, 0.75]) if e > y.min()})
    bins = {}
    for k, v in rows:
        bins.setdefault(1 + sum(v > e for e in edges), []).append(k)
    train = set()
    for members in bins.values():
        ranked = sorted(members, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))
        train.update(ranked[: math.ceil(len(members) * share)])
    return train, [len(m) for m in bins.values()]


@pytest.mark.parametrize("max_window_rows", [200_000, 1])
def test_split_matches_brute_force(spark, max_window_rows):
    df, rows = targets(spark)
    rule = split.fit_split(df, "k", "y", max_window_rows=max_window_rows)
    got = {r["k"] for r in rule.apply(df).where("dataset = 'Train'").collect()}
    train, sizes = brute_force(rows)
    assert got == train
    assert sorted(n for n, _ in rule.sizes.values()) == sorted(sizes)
    assert len(got) == split.expected_train_rows(sizes)


def test_split_does_not_depend_on_partitioning(spark):
    df, _ = targets(spark, 300)
    a = split.fit_split(df, "k", "y")
    b = split.fit_split(df.repartition(1).orderBy(F.desc("k")), "k", "y")
    assert a == b


def test_tied_edges_and_missing_targets(spark):
    rows = [(f"k{i}", 1.0) for i in range(60)] + [(f"m{i}", 2.0) for i in range(10)] + [("n", None)]
    df = spark.createDataFrame(rows, "k string, y double")
    rule = split.fit_split(df, "k", "y")
    assert rule.edges == () and rule.n_without_target == 1
    sizes = {r["dataset"]: r["n"] for r in split.split_sizes(rule.apply(df)).collect()}
    assert sizes == {"Train": 56, "Test": 14, None: 1}


def test_constant_and_empty_target(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, y double")
    assert split.fit_split(df, "k", "y").apply(df).where("dataset = 'Train'").count() == 3
    none = df.where("y > 5")
    assert split.fit_split(none, "k", "y").apply(none).count() == 0


def test_medians_come_from_training_rows_only(spark):
    rows = [("Train", 1.0), ("Train", 3.0), ("Train", None), ("Test", 100.0), ("Test", None)]
    df = spark.createDataFrame(rows, "dataset string, x double")
    medians = impute.train_medians(df, ["x"]).first().asDict()
    assert medians == {"x": 2.0}
    filled = impute.fill_medians(df, medians)
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0, 100.0]


@pytest.mark.parametrize("max_levels", [10_000, 0])
def test_levels_unknown_to_training_rows(spark, max_levels):
    rows = [("Train", "a", "p"), ("Train", "b", None), ("Test", "c", "p"), ("Test", None, "q")]
    df = spark.createDataFrame(rows, "dataset string, c string, d string")
    out = impute.restrict_levels(df, ["c", "d"], max_levels=max_levels)
    assert set(tuple(r) for r in out.collect()) == {
        ("Train", "a", "p"),
        ("Train", "b", None),
        ("Test", None, "p"),
        ("Test", None, None),
    }


def test_unknown_and_means(spark):
    df = spark.createDataFrame([(None, 2.0), ("None", 4.0)], "p string, x double")
    assert {r["p"] for r in impute.fill_unknown(df, ["p"]).collect()} == {"Unknown", "None"}
    out = impute.compare_means(df, df.where("x > 3"), ["x"], {"x": "X value"}).collect()
    assert {(r["variable"], r["stage"], r["mean_value"]) for r in out} == {
        ("X value", "Before imputation", 3.0),
        ("X value", "After imputation", 4.0),
    }


def test_written_rows_are_hashed_once(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("booking_id"), (F.col("id") % 89).cast("double").alias("basket_value"))
    df = df.unionByName(spark.createDataFrame([(None, 3.0), ("n1", None)], "booking_id string, basket_value double"))
    table, rule = plans.split_table(df)
    assert table.columns == ["booking_id", "basket_value", "dataset"]
    assert "md5" not in table._jdf.queryExecution().optimizedPlan().toString()
    plain = split.fit_split(df, "booking_id", "basket_value")
    assert rule == plain
    assert sorted(map(str, table.collect())) == sorted(map(str, plain.apply(df).collect()))
