"""The ``bookings`` view over the star-schema test tables.

One row per ``lineitem`` row.  Defects (nulls, blanks, padding, zeros, unreadable
numbers) are injected from a hash of the keys, so the same rows are affected in
every engine and at every scale.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the fixture.
COLUMNS = (
    "booking_id",
    "booking_datetime",
    "customer_segment",
    "service_type",
    "customer_age",
    "city",
    "payment_method",
    "booking_channel",
    "distance_km",
    "estimated_duration_min",
    "promo_code_used",
    "discount_amount",
    "traffic_level",
    "weather_condition",
    "cancellation_reason",
    "basket_value",
    "ord_a",
    "ord_b",
    "ord_c",
)

# One expression per column; ``h`` is the hash of the row's keys.
_EXPRESSIONS = {
    "booking_id": "concat('B', l_orderkey, '-', l_linenumber)",
    "booking_datetime": """
        if(h % 53 = 0, NULL, concat(
            substring(cast(l_shipdate AS string), 1, 10), ' ',
            lpad(cast(h % 24 AS string), 2, '0'), ':', lpad(cast(h % 60 AS string), 2, '0')))""",
    "customer_segment": "if(h % 61 = 0, NULL, c_mktsegment)",
    "service_type": "if(h % 101 = 0, concat(o_orderpriority, ' '), o_orderpriority)",
    "customer_age": """
        CASE WHEN h % 23 = 0 THEN NULL WHEN h % 997 = 0 THEN -1D
             ELSE cast(18 + c_custkey % 45 AS double) END""",
    "city": "n_name",
    "payment_method": """
        CASE WHEN h % 29 = 0 THEN NULL WHEN h % 31 = 0 THEN ''
             WHEN h % 37 = 0 THEN concat('  ', l_returnflag, ' ') ELSE l_returnflag END""",
    "booking_channel": "l_linestatus",
    "distance_km": """
        CASE WHEN h % 19 = 0 THEN NULL WHEN h % 499 = 0 THEN 0D ELSE l_quantity / 4 END""",
    "estimated_duration_min": """
        CASE WHEN h % 67 = 0 THEN NULL WHEN h % 503 = 0 THEN 0D
             ELSE cast(8 + l_suppkey % 60 AS double) END""",
    "promo_code_used": "if(h % 41 = 0, NULL, p_type)",
    "discount_amount": """
        CASE WHEN h % 43 = 0 THEN NULL WHEN h % 59 = 0 THEN 'n/a'
             ELSE cast(cast(round(l_discount * 100) AS int) * 1000 AS string) END""",
    "traffic_level": "if(h % 43 = 0, NULL, o_orderstatus)",
    "weather_condition": "if(h % 71 = 0, NULL, p_brand)",
    "cancellation_reason": "if(h % 20 = 0, l_linestatus, NULL)",
    "basket_value": "l_extendedprice",
    "ord_a": "l_partkey",
    "ord_b": "l_suppkey",
    "ord_c": "l_shipdate",
}


def bookings(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The view, or the asked columns of it.

    The view is its four inner joins, whatever columns are asked: a fact row without a match
    is in no result.  Catalyst leaves out the columns.  No join is hinted: Spark broadcasts
    a dimension when its size is under the session's threshold and shuffles it otherwise.
    """
    wanted = [c for c in COLUMNS if columns is None or c in set(columns)]

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    hash_ = "l_orderkey * 31 + l_partkey * 7 + l_linenumber"
    df = (
        table("lineitem")
        .withColumn("h", F.expr(hash_))
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return df.selectExpr(*[f"{_EXPRESSIONS[c]} AS {c}" for c in wanted])
