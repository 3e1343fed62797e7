"""Named queries against their SQL, on the smallest test tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, shape  # noqa: E402

# One or two per family; tools/check.py runs all of them.
CHECKED = [
    "load_bookings",
    "schema_profile",
    "dup_rows",
    "dedupe_first",
    "missing_summary",
    "missing_labels",
    "missing_impact",
    "cat_missing_diff",
    "time_features",
    "factor_levels",
    "value_by_service",
    "value_by_category",
    "correlations",
    "events_iqr_fence",
    "stratified_split",
    "final_cleaned",
    "histogram_high_value",
    "boxplot_segment_service",
    "events_outliers",
    "roc_auc",
]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    made = con.execute(entry.oracle_sql()[name])
    want = shape([d[0] for d in made.description], made.fetchall())
    assert shape(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fixture_facts(spark, sf):
    from pyspark.sql import functions as F

    from valuelab.sources import bookings

    df = bookings(spark, sf)
    row = df.agg(
        F.count("*"),
        F.count_distinct("booking_id"),
        F.count("booking_datetime"),
        F.count("customer_age"),
        F.count_if(F.col("customer_age") < 0),
        F.count_if(F.col("payment_method") == ""),
        F.count("distance_km"),
        F.count_if(F.col("distance_km") == 0),
        F.count("discount_amount"),
        F.count("weather_condition"),
        F.count("cancellation_reason"),
    ).first()
    assert tuple(row) == (6000, 4599, 5887, 5752, 3, 173, 5669, 8, 5850, 5914, 311)
