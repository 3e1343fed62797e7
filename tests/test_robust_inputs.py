"""Rows that used to leave, text that used to change, numbers that used to be off."""

import math

import pytest
from pyspark.sql import functions as F

from valuelab import plans, sources
from valuelab.functions.distributions import _t_tail, t_quantile
from valuelab.models import logistic
from valuelab.operators import plotdata, profile, split
from valuelab.operators.quantiles import default_name
from valuelab.sources.bookings import bookings


@pytest.mark.parametrize(
    "df, want",
    [
        (3, 3.182446305284263),
        (10, 2.2281388519649385),
        (100, 1.9839715184496334),
        (10**9, 1.9599639869),
    ],
)
def test_t_quantile(df, want):
    assert t_quantile(0.975, df) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("df", [1_000, 10_000, 100_000])
def test_t_quantile_cuts_off_its_tail(df):
    assert _t_tail(t_quantile(0.975, df), df, 200_000) == pytest.approx(0.025, rel=1e-8)


def test_t_quantile_is_smooth_where_the_method_changes():
    below, above = t_quantile(0.975, 999.999), t_quantile(0.975, 1000)
    assert below == pytest.approx(above, rel=1e-8)


def test_csv_keeps_text(spark):
    texts = ['say "hi", ok', "two\nlines", "  padded  ", "", None, "back\\slash", "a;b", "'q'"]
    df = spark.createDataFrame([(i, t, 0.1 * i) for i, t in enumerate(texts)], "k int, t string, v double")
    path = sources.work_folder(spark)
    sources.export_csv(df, path)
    back = sources.load_table(spark, path, df.schema, "csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_refuses_the_null_marker(spark):
    df = spark.createDataFrame([("NA",)], "t string")
    with pytest.raises(Exception, match="stands for missing"):
        sources.export_csv(df, sources.work_folder(spark))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_reconcile_sees_a_renamed_column_and_an_altered_cell(spark, fmt):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k int, t string, v double")

    def verdict(changed):
        path = sources.work_folder(spark)
        (sources.export_csv if fmt == "csv" else sources.export_parquet)(changed, path)
        back = sources.load_table(spark, path, df.schema if fmt == "csv" else None, fmt)
        row = sources.reconcile(df, back, "v", sources.columns_of(spark, path, fmt)).first()
        return row.same_columns, row.same_content, row.complete

    assert verdict(df) == (True, True, True)
    assert verdict(df.withColumnRenamed("t", "u"))[0] is False
    assert verdict(df.withColumnRenamed("t", "u"))[2] is False
    altered = df.withColumn("t", F.when(F.col("k") == 1, "z").otherwise(F.col("t")))
    assert verdict(altered) == (True, False, False)


def test_blank_cells_count_as_empty(spark):
    df = spark.createDataFrame([("",), ("   ",), ("a",), (None,)], "t string")
    assert profile.empty_values(df, ["t"]).first()["n"] == 2


def test_null_key_has_one_side_and_counts_hold(spark):
    df = spark.range(40).select(
        F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").cast("double").alias("y")
    )
    rule = split.fit_split(df, "k", "y")
    sided = rule.apply(df)
    for b in range(4):
        part = sided.where((F.col("y") >= b * 10) & (F.col("y") < b * 10 + 10))
        assert abs(part.where("dataset = 'Train'").count() - 8) <= 1
    assert sided.where("dataset = 'Train'").count() == sum(n for _, n in rule.sizes.values())


def test_rows_without_a_target_stay_in_the_full_table(spark):
    df = spark.range(20).select("id", F.when(F.col("id") > 2, F.col("id").cast("double")).alias("y"))
    sided = split.fit_split(df, "id", "y").apply(df)
    assert sided.count() == 20 and sided.where("dataset is null").count() == 3
    written = plans.write_datasets(sided, sources.work_folder(spark), "parquet")
    counts = {k: sources.load_table(spark, path).count() for k, (_, path) in written.items()}
    assert counts["Full"] == 20 and counts["Train"] + counts["Test"] == 17


def test_infinity_is_in_no_bin(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert plotdata.histogram(df, "x").agg(F.sum("n")).first()[0] == 2


def test_quantile_names_differ():
    assert default_name("x", 0.25) == "x_p25"
    assert default_name("x", 0.999) != default_name("x", 0.995) != default_name("x", 1.0)


def test_separated_data_is_not_reported_as_settled(spark):
    df = spark.range(40).select((F.col("id") >= 20).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    fit = logistic.fit_logit(df, "y", ["x"])
    assert not fit.converged
    assert not fit.coefficients(df).first()["converged"]


def test_unscorable_rows_stay_with_null(spark):
    train = spark.range(60).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
    )
    fit = logistic.fit_logit(train, "y", ["x", "c"])
    new = spark.createDataFrame([(1.0, "a"), (None, "a"), (1.0, "new"), (math.nan, "b"), (2.0, None)], "x double, c string")
    got = fit.score(new).collect()
    assert len(got) == 5 and sum(r.probability is not None for r in got) == 1


def test_rows_of_the_view_do_not_depend_on_the_columns(spark, sf, tmp_path):
    for name in ("lineitem", "orders", "customer", "nation", "part"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "part":
            table = table.where("p_partkey % 5 <> 0")  # orphans
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    all_ = bookings(spark, str(tmp_path)).count()
    one = bookings(spark, str(tmp_path), ["basket_value"]).count()
    assert all_ == one < spark.read.parquet(f"{sf}/lineitem.parquet").count()
