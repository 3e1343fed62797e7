"""Column expressions and row-wise cleaning on small frames, one trap each."""

import datetime as dt
import math

from pyspark.sql import functions as F

from valuelab.functions import day_name, parse_minute, pearson, skewness_sample_sd
from valuelab.operators import clean
from valuelab.sources import coerce_numeric


def values(df, column):
    return [r[column] for r in df.collect()]


def test_numbers_from_text(spark):
    text = ["12", " 12 ", "4e+05", "1,000", "n/a", "NaN", None, "12d", "1f", "-3.5", ""]
    df = spark.createDataFrame([(t,) for t in text], "x string").coalesce(1)
    got = values(coerce_numeric(df, ["x"]), "x")
    assert got == [12.0, 12.0, 400000.0, None, None, None, None, None, None, -3.5, None]


def test_numeric_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,)], "x double").coalesce(1)
    assert values(coerce_numeric(df, ["x"]), "x") == [1.0, None]


def test_clean_categories(spark):
    text = [" a ", "\ta\u00a0\u3000", " \u2003 ", "", None, "None", "NA", "a\u00a0b"]
    df = spark.createDataFrame([(t,) for t in text], "x string").coalesce(1)
    got = values(clean.clean_categories(df, ["x"]), "x")
    assert got == ["a", "a", None, None, None, "None", "NA", "a\u00a0b"]


def test_times(spark):
    text = [
        "2024-01-06 00:00",
        "2024-01-07 05:59:33",
        "2024-1-8 6:5",
        "2024-01-08 23:10 later",
        "2024-02-30 10:00",
        "junk",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in text], "t string").coalesce(1)
    out = clean.time_features(clean.parse_times(df, "t"), "t").collect()
    assert [r["t"] for r in out][:4] == [
        dt.datetime(2024, 1, 6, 0, 0),
        dt.datetime(2024, 1, 7, 5, 59),
        dt.datetime(2024, 1, 8, 6, 5),
        dt.datetime(2024, 1, 8, 23, 10),
    ]
    assert [r["t"] for r in out][4:] == [None] * 3
    assert [r["booking_day"] for r in out] == ["Saturday", "Sunday", "Monday", "Monday"] + [None] * 3
    assert [r["is_weekend"] for r in out] == ["Weekend"] * 2 + ["Weekday"] * 5
    assert [r["time_period"] for r in out] == [
        "Early Morning",
        "Early Morning",
        "Morning",
        "Night",
        None,
        None,
        None,
    ]
    night = clean.time_features(clean.parse_times(df, "t"), "t", night_fallback=True)
    assert values(night, "time_period")[-3:] == ["Night"] * 3


def test_time_period_edges(spark):
    hours = [0, 5, 6, 10, 11, 13, 14, 16, 17, 20, 21, 23]
    df = spark.createDataFrame([(f"2024-01-05 {h:02d}:00",) for h in hours], "t string").coalesce(1)
    got = values(clean.time_features(clean.parse_times(df, "t"), "t"), "time_period")
    names = ["Early Morning", "Morning", "Lunch", "Afternoon", "Evening", "Night"]
    assert got == [n for n in names for _ in range(2)]


def test_time_does_not_depend_on_session_zone(spark):
    df = spark.createDataFrame([("2024-03-31 02:30",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        row = df.select(F.hour(parse_minute(F.col("t"))).alias("h"), day_name(parse_minute(F.col("t")))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row[0] == 2 and row[1] == "Sunday"


def test_distance_needs_a_known_speed_within_the_limit(spark):
    rows = [
        (10.0, 12.0, 10.0),  # exactly 50 km/h stays
        (10.01, 12.0, None),
        (10.0, None, None),  # unknown duration blanks the distance
        (10.0, 0.0, None),
        (None, 10.0, None),
        (0.0, 10.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "d double, t double, want double").coalesce(1)
    out = clean.clean_distance(clean.flag_speed(df, "d", "t"), "d", "t").collect()
    assert [r["distance_km_clean"] for r in out] == [r["want"] for r in out]
    assert [r["distance_invalid"] for r in out] == [False, True, None, None, None, False]
    effect = clean.cleaning_effect(
        clean.clean_distance(clean.flag_speed(df, "d", "t"), "d", "t"), "d"
    ).first()
    assert tuple(effect) == (1, 4, 3, 1)


def test_keep_categories_judges_raw_text(spark):
    df = spark.createDataFrame([("a", 1.0), ("a ", 1.0), ("a", None), (None, 1.0)], "s string, y double")
    assert clean.keep_categories(df, "s", ["a"]).count() == 2
    assert clean.keep_categories(df, "s", ["a"], "y").count() == 1


def test_pearson_and_skewness_on_constant_input(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    row = df.agg(pearson(F.col("a"), F.col("b")), skewness_sample_sd(F.col("a"))).first()
    assert tuple(row) == (None, None)


def test_pearson_uses_complete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 9.0), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = df.agg(pearson(F.col("a"), F.col("b"))).first()[0]
    want = df.dropna().agg(F.corr("a", "b")).first()[0]
    assert abs(got - want) < 1e-12


def test_skewness_formula(spark):
    x = [1.0, 2.0, 4.0, 9.0, 20.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    m = sum(x) / 5
    sd = math.sqrt(sum((v - m) ** 2 for v in x) / 4)
    want = sum((v - m) ** 3 for v in x) / 5 / sd**3
    assert abs(df.agg(skewness_sample_sd(F.col("x"))).first()[0] - want) < 1e-12
