"""Duplicates, missingness, profiling, summaries, reshape and figures on small frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from valuelab.operators import dedupe, missing, plotdata, profile, reshape, summarise
from valuelab.sources import export_csv, export_parquet, load_table, reconcile


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def keys(spark):
    rows = [("a", 2, "y"), ("a", 1, "x"), (None, 5, "p"), (None, 4, "q"), ("b", 9, "z")]
    return spark.createDataFrame(rows, "k string, o int, v string").repartition(3)


def test_duplicates_with_null_key(spark):
    df = keys(spark)
    assert rows_of(dedupe.duplicate_summary(df, "k")) == [(5, 3, 2)]
    assert rows_of(dedupe.duplicate_rows(df, "k", ["o"])) == [
        ("a", 1, "x"),
        ("a", 2, "y"),
        (None, 4, "q"),
        (None, 5, "p"),
    ]
    first = dedupe.dedupe_first(df, "k", ["o"])
    want = {("a", 1, "x"), (None, 4, "q"), ("b", 9, "z")}
    assert set(rows_of(first)) == want
    assert set(rows_of(dedupe.dedupe_first(first, "k", ["o"]))) == want
    assert rows_of(dedupe.duplicate_summary(df.limit(0), "k")) == [(0, 0, 0)]


def test_dedupe_keeps_one_row_per_task_before_the_shuffle(spark):
    plan = dedupe.dedupe_first(keys(spark), "k", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_missing_profile_counts_nan(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (math.nan, None), (None, "b"), (2.0, None)], "x double, s string"
    )
    assert rows_of(missing.missing_profile(df)) == [("s", 2, 50.0), ("x", 2, 50.0)]
    flagged = missing.flag_missing(df, ["x", "s"])
    assert {r["has_missing"]: r["n"] for r in missing.group_sizes(flagged, "has_missing").collect()} == {
        "Complete": 1,
        "Has Missing Data": 3,
    }


def test_percent_text(spark):
    df = spark.createDataFrame([(5.0,), (0.25,), (12.34,), (0.0,)], "x double").coalesce(1)
    got = [r[0] for r in df.select(missing.percent_text(F.col("x"))).collect()]
    assert got == ["5", "0.2", "12.3", "0"]


def test_labels_fall_back_to_the_name(spark):
    df = spark.createDataFrame([("city", 5.0), ("other", 1.25)], "variable string, percentage double")
    got = dict(rows_of(missing.missing_labels(df, {"city": "City"})))
    assert got == {"city": "City\n(5%)", "other": "other\n(1.2%)"}


def test_share_gap_with_one_group_absent(spark):
    df = spark.createDataFrame([("Complete", "a"), ("Complete", "b")], "has_missing string, c string")
    shares = missing.category_shares_by(df, "has_missing", ["c"])
    out = rows_of(missing.category_share_gap(shares, "has_missing"))
    assert out == [("c", "a", 50.0, 0.0, -50.0), ("c", "b", 50.0, 0.0, -50.0)]
    assert rows_of(missing.category_gap(df, "has_missing", ["c"])) == out
    assert missing.category_gap(df.limit(0), "has_missing", ["c"]).count() == 0


def test_mean_difference_without_other_group(spark):
    df = spark.createDataFrame([("Complete", 2.0)], "g string, y double")
    assert rows_of(missing.mean_difference(df, "g", "y")) == [(2.0, None, None, None)]


def test_map_grid_counts_every_cell(spark):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("k"), F.when(F.col("id") % 4 != 0, 1.0).alias("x")
    )
    grid = missing.missing_map_grid(df, "k", ["x"], digits=1)
    total = grid.agg(F.sum("missing"), F.sum("present"), F.count("*")).first()
    assert tuple(total) == (50, 150, 16)
    assert missing.missing_map(df, "k", ["x"]).where("status = 'Missing'").count() == 50


def test_category_tables(spark):
    df = spark.createDataFrame(
        [(" a", 1.0), ("a", None), ("", 2.0), (None, None), ("a", 3.0)], "c string, d double"
    )
    assert rows_of(profile.category_values(df, ["c"])) == [("c", ""), ("c", " a"), ("c", "a"), ("c", None)]
    assert rows_of(profile.category_values(df, ["c"], trimmed=True, keep_null=False)) == [
        ("c", ""),
        ("c", "a"),
    ]
    assert rows_of(profile.all_category_counts(df, ["c"]))[0] == ("c", "a", 2)
    assert rows_of(profile.padded_values(df, ["c"])) == [("c", " a", 1)]
    assert rows_of(profile.empty_values(df, ["c"])) == [("c", 1)]
    cross = set(rows_of(profile.missing_crosstab(df, "c", "d")))
    assert cross == {
        (" a", True, 0),
        (" a", False, 1),
        ("a", True, 1),
        ("a", False, 1),
        ("", True, 0),
        ("", False, 1),
        (None, True, 1),
        (None, False, 0),
    }


def test_schema_profile_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (1.0, "b")], "x double, s string")
    assert rows_of(profile.schema_profile(df)) == [
        (1, "x", "double", 1, 2),
        (2, "s", "string", 0, 2),
    ]
    assert rows_of(profile.schema_profile(df, exact=False))[1][4] == 2


def test_summary_strict_and_degenerate(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None), ("a", None)], "g string, x double"
    )
    loose = {r["g"]: r for r in summarise.summarise(df, "x", ["g"]).collect()}
    assert (loose["a"]["n"], loose["a"]["mean"], loose["a"]["median"]) == (2, 1.5, 1.5)
    assert (loose["b"]["sd"], loose["b"]["q3"]) == (None, 5.0)
    assert loose["c"]["n"] == 0 and loose["c"]["median"] is None
    strict = {r["g"]: r for r in summarise.summarise(df, "x", ["g"], strict_null=True).collect()}
    assert strict["a"]["mean"] is None and strict["a"]["median"] is None
    assert strict["b"]["median"] == 5.0


def test_shares_sum_to_one_hundred(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y")], "c string, d string")
    sums = summarise.category_shares(df, ["c", "d"]).groupBy("variable").agg(F.sum("percentage"))
    assert all(abs(r[1] - 100) < 1e-9 for r in sums.collect())


def test_proportions_show_levels_without_rows(spark):
    df = spark.createDataFrame(
        [("Train", "a"), ("Train", "b"), ("Test", "a"), ("Test", None)], "side string, c string"
    )
    out = set(rows_of(summarise.proportions_by(df, "side", ["Train", "Test"], ["c"])))
    assert out == {
        ("c", "Train", "a", 0.5),
        ("c", "Train", "b", 0.5),
        ("c", "Test", "a", 1.0),
        ("c", "Test", "b", 0.0),
    }


def test_fences(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0, -90.0, None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    row = summarise.iqr_fences(df, "x").first()
    q1, q3 = np.quantile([v for v in x if v is not None], [0.25, 0.75])
    assert (row["q1"], row["q3"]) == (q1, q3)
    assert (row["n_below"], row["n_above"], row["n_outliers"]) == (1, 1, 2)
    empty = summarise.iqr_fences(df.where("x IS NULL"), "x").first()
    assert empty["iqr"] is None and empty["n_outliers"] == 0


def test_levels(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    b = spark.createDataFrame([("z",), ("y",)], "c string")
    assert {r["level"] for r in reshape.union_levels(a, b, ["c"]).collect()} == {"x", "y", "z"}
    assert set(rows_of(reshape.factor_levels(a, ["c"]))) == {("c", "x", 1), ("c", "y", 2)}
    both = reshape.stack({"one": a, "two": b.withColumn("d", F.lit(1))})
    assert both.count() == 5 and both.columns == ["c", "dataset", "d"]
    v = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("y", 9.0), (None, 99.0)], "c string, v double")
    assert rows_of(reshape.levels_by_median(v, "c", "v")) == [("y", 6.0), ("x", 1.0)]


def test_histogram_keeps_every_row(spark):
    rng = np.random.default_rng(4)
    x = rng.exponential(10, 3000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    out = plotdata.histogram(df, "x").orderBy("bin").collect()
    width = (x.max() - x.min()) / 29
    assert sum(r["n"] for r in out) == 3000
    for r in out[1:]:
        inside = ((x > r["centre"] - width / 2) & (x <= r["centre"] + width / 2)).sum()
        assert abs(int(inside) - r["n"]) <= 1  # an edge may fall either way in floating point
    one = plotdata.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").collect()
    assert [r["n"] for r in one] == [3]
    assert plotdata.histogram(df.where("x IS NULL"), "x").collect() == []


def test_box_plot(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 50]] + [("b", 7.0), (None, 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r for r in plotdata.box_plot(df, "x", ["g"]).collect()}
    assert (out["a"]["whisker_low"], out["a"]["whisker_high"], out["a"]["n_outliers"]) == (1.0, 5.0, 1)
    assert out["b"]["whisker_high"] == 7.0 and out["c"]["n"] == 0
    assert set(r["g"] for r in plotdata.box_plot_pairs(df, "x", ["g"]).collect()) == {"a", "b"}
    whole = plotdata.box_plot(df, "x").first()
    assert whole["n"] == 8
    boxes = plotdata.box_plot(df, "x", ["g"])
    assert rows_of(plotdata.outliers(df, "x", boxes, ["g"])) == [("a", 50.0)]


def test_density_counts_pairs(spark):
    rows = [(float(i % 10), float(i)) for i in range(500)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert plotdata.density_2d(df, "x", "y").agg(F.sum("n")).first()[0] == 500


def test_line_and_band(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(10, 3, 400)
    y = 2 + 0.5 * x + rng.normal(0, 1, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(1.0, None)], "x double, y double")
    fit = plotdata.line_fit(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    resid = y - intercept - slope * x
    se = math.sqrt((resid**2).sum() / 398)
    assert np.allclose([fit["slope"], fit["intercept"], fit["residual_se"]], [slope, intercept, se])
    band = plotdata.line_band(df, "x", "y", points=5).orderBy("x").collect()
    at = band[2]["x"]
    half = 1.965942 * se * math.sqrt(1 / 400 + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert len(band) == 5 and abs((band[2]["high"] - band[2]["low"]) / 2 - half) < 1e-5


def test_exports_read_back(spark, tmp_path):
    rows = [("a", "None", 1.5), ("b", None, None), ("c, d", 'say "x"', 4e5)]
    df = spark.createDataFrame(rows, "k string, promo string, y double")
    export_csv(df, str(tmp_path / "csv"))
    export_parquet(df, str(tmp_path / "parquet"))
    for fmt in ("csv", "parquet"):
        back = load_table(spark, str(tmp_path / fmt), df.schema, fmt)
        assert set(rows_of(back)) == set(rows)
        assert reconcile(df, back, "y").first()["complete"] is True
    short = df.limit(2)
    assert reconcile(df, short, "y").first()["complete"] is False
