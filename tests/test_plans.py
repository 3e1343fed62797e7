"""The preparation pipeline with other column names, and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from valuelab import plans
from valuelab.sources import bookings, load_table

OTHER = plans.Layout(
    target="order_value_eur",
    discount="discount_eur",
    services=("2-HIGH", "3-MEDIUM", "5-LOW"),
    order_by=("ord_a", "ord_b", "ord_c", "order_value_eur"),
)


def test_prepare_with_other_names(spark, sf, tmp_path):
    raw = bookings(spark, sf).withColumnsRenamed(
        {"basket_value": "order_value_eur", "discount_amount": "discount_eur"}
    )
    filled = plans.prepare(raw, str(tmp_path / "out"), OTHER)
    assert filled.columns == [*OTHER.model, "dataset"]
    sizes = {}
    for name in ("train", "test", "full"):
        back = load_table(
            spark, str(tmp_path / "out" / f"{name}_cleaned"), filled.drop("dataset").schema, "csv"
        )
        sizes[name] = back.count()
        filled_columns = [*OTHER.impute_numeric, *OTHER.impute_unknown]
        assert back.where(" OR ".join(f"{c} IS NULL" for c in filled_columns)).count() == 0
        assert back.agg(F.count_distinct(OTHER.key)).first()[0] == sizes[name]
    assert sizes["train"] + sizes["test"] == sizes["full"]
    assert 0 <= sizes["train"] - 0.8 * sizes["full"] < 4


def test_fitted_facts_ignore_test_rows(spark):
    rows = [("Train", 20.0, 1.0, 10.0), ("Train", 40.0, 3.0, 20.0), ("Test", 9e9, 9e9, 9e9)]
    df = spark.createDataFrame(rows, "dataset string, customer_age double, distance_km_clean double, basket_value double")
    facts = plans.train_facts(df)
    assert facts.medians == {"customer_age": 30.0, "distance_km_clean": 2.0}
    assert facts.threshold == 18.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["dedupe_first", "dup_rows", "missing_counts", "cat_missing_diff", "value_by_service", "density2d"]
)
def test_no_cross_products(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark, sf):
    text = plan(entry.queries()["category_counts"](spark, sf))
    assert "l_extendedprice" in text and "l_tax" not in text and "l_quantity" not in text
    assert "c_acctbal" not in text and "customer.parquet" in text  # joined for its rows alone


def test_hot_key(spark):
    """A key with a third of all rows gives the same first row, and the same counts."""
    from valuelab.operators import dedupe

    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (-F.col("id")).alias("o"),
    )
    first = dedupe.dedupe_first(df, "k", ["o"])
    assert first.count() == 20_001
    assert first.where("k = 'hot'").first()["o"] == -29_997
    assert tuple(dedupe.duplicate_summary(df, "k").first()) == (30_000, 20_001, 9_999)
    assert dedupe.duplicate_rows(df, "k", ["o"]).count() == 10_000
