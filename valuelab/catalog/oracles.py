"""Each named query as SQL for an independent engine.

The statements share a chain of CTEs (bookings -> typed -> kept -> basket ->
rich -> model -> sided -> filled); each query takes the part of it that it needs.
"""

from __future__ import annotations

SERVICES = "('1-URGENT', '2-HIGH')"
CATEGORICAL = [
    "customer_segment",
    "service_type",
    "city",
    "payment_method",
    "booking_channel",
    "promo_code_used",
    "traffic_level",
    "weather_condition",
]
ANALYSIS = [
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
    "basket_value",
]
MODEL = [
    "booking_id",
    "customer_segment",
    "service_type",
    "customer_age",
    "city",
    "payment_method",
    "booking_channel",
    "distance_km_clean",
    "estimated_duration_min",
    "time_period",
    "is_weekend",
    "promo_code_used",
    "discount_amount",
    "traffic_level",
    "weather_condition",
    "basket_value",
]
RAW = [
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
]

_BOOKINGS = """
keyed AS (
  SELECT *, l_orderkey * 31 + l_partkey * 7 + l_linenumber AS h FROM lineitem
),
bookings AS (
  SELECT
    'B' || l_orderkey || '-' || l_linenumber AS booking_id,
    CASE WHEN h % 53 = 0 THEN NULL
         ELSE strftime(l_shipdate, '%Y-%m-%d') || ' ' || lpad(CAST(h % 24 AS VARCHAR), 2, '0')
              || ':' || lpad(CAST(h % 60 AS VARCHAR), 2, '0') END AS booking_datetime,
    CASE WHEN h % 61 = 0 THEN NULL ELSE c_mktsegment END AS customer_segment,
    CASE WHEN h % 101 = 0 THEN o_orderpriority || ' ' ELSE o_orderpriority END AS service_type,
    CASE WHEN h % 23 = 0 THEN NULL WHEN h % 997 = 0 THEN -1.0::DOUBLE
         ELSE CAST(18 + c_custkey % 45 AS DOUBLE) END AS customer_age,
    n_name AS city,
    CASE WHEN h % 29 = 0 THEN NULL WHEN h % 31 = 0 THEN ''
         WHEN h % 37 = 0 THEN '  ' || l_returnflag || ' ' ELSE l_returnflag END AS payment_method,
    l_linestatus AS booking_channel,
    CASE WHEN h % 19 = 0 THEN NULL WHEN h % 499 = 0 THEN 0.0::DOUBLE
         ELSE l_quantity / 4 END AS distance_km,
    CASE WHEN h % 67 = 0 THEN NULL WHEN h % 503 = 0 THEN 0.0::DOUBLE
         ELSE CAST(8 + l_suppkey % 60 AS DOUBLE) END AS estimated_duration_min,
    CASE WHEN h % 41 = 0 THEN NULL ELSE p_type END AS promo_code_used,
    CASE WHEN h % 43 = 0 THEN NULL WHEN h % 59 = 0 THEN 'n/a'
         ELSE CAST(CAST(round(l_discount * 100) AS INTEGER) * 1000 AS VARCHAR) END AS discount_amount,
    CASE WHEN h % 43 = 0 THEN NULL ELSE o_orderstatus END AS traffic_level,
    CASE WHEN h % 71 = 0 THEN NULL ELSE p_brand END AS weather_condition,
    CASE WHEN h % 20 = 0 THEN l_linestatus END AS cancellation_reason,
    l_extendedprice AS basket_value,
    l_partkey AS ord_a, l_suppkey AS ord_b, l_shipdate AS ord_c
  FROM keyed
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

_TYPED = """
typed AS (
  SELECT * REPLACE (TRY_CAST(discount_amount AS DOUBLE) AS discount_amount) FROM bookings
)"""

_KEPT = f"""
kept AS (SELECT * FROM typed WHERE service_type IN {SERVICES})"""

_RAW_BASKET = """
raw_basket AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY booking_id ORDER BY ord_a, ord_b, ord_c, basket_value) AS rn FROM kept
  ) WHERE rn = 1
)"""

_BASKET = (
    """
basket AS (
  SELECT * REPLACE ("""
    + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in CATEGORICAL)
    + """) FROM raw_basket
)"""
)


def _rich(source: str) -> str:
    nulls = " OR ".join(f"{c} IS NULL" for c in ANALYSIS)
    return f"""
timed AS (
  SELECT * REPLACE (TRY_CAST(booking_datetime || ':00' AS TIMESTAMP) AS booking_datetime),
    CASE WHEN {nulls} THEN 'Has Missing Data' ELSE 'Complete' END AS has_missing,
    distance_km / nullif(estimated_duration_min, 0) * 60 AS estimated_speed_kmh
  FROM {source}
),
rich AS (
  SELECT *,
    CAST(hour(booking_datetime) AS INTEGER) AS booking_hour,
    dayname(booking_datetime) AS booking_day,
    CASE WHEN dayofweek(booking_datetime) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS is_weekend,
    CASE WHEN hour(booking_datetime) < 6 THEN 'Early Morning'
         WHEN hour(booking_datetime) < 11 THEN 'Morning'
         WHEN hour(booking_datetime) < 14 THEN 'Lunch'
         WHEN hour(booking_datetime) < 17 THEN 'Afternoon'
         WHEN hour(booking_datetime) < 21 THEN 'Evening'
         WHEN hour(booking_datetime) < 24 THEN 'Night' END AS time_period,
    estimated_speed_kmh > 50 AS distance_invalid,
    CASE WHEN estimated_speed_kmh <= 50 THEN distance_km END AS distance_km_clean
  FROM timed
)"""


_RICH = _rich("basket")
_MODEL = f"""
model AS (SELECT {", ".join(MODEL)} FROM rich)"""

_SIDED = """
edges AS (
  SELECT quantile_cont(basket_value, 0.25) AS e1, quantile_cont(basket_value, 0.5) AS e2,
         quantile_cont(basket_value, 0.75) AS e3 FROM model
),
binned AS (
  SELECT model.*, 1 + CAST(basket_value > e1 AS INTEGER) + CAST(basket_value > e2 AS INTEGER)
         + CAST(basket_value > e3 AS INTEGER) AS bin,
         substr(md5(booking_id || ':123'), 1, 32) AS hash
  FROM model, edges
),
sided AS (
  SELECT * EXCLUDE (hash, rk, nb),
    CASE WHEN rk <= ceil(nb * 0.8::DOUBLE) THEN 'Train' ELSE 'Test' END AS dataset
  FROM (
    SELECT *, row_number() OVER (PARTITION BY bin ORDER BY hash, booking_id) AS rk,
           count(*) OVER (PARTITION BY bin) AS nb
    FROM binned
  )
)"""

_FILLED = """
medians AS (
  SELECT quantile_cont(customer_age, 0.5) AS m_age, quantile_cont(distance_km_clean, 0.5) AS m_distance
  FROM sided WHERE dataset = 'Train'
),
filled AS (
  SELECT sided.* EXCLUDE (bin) REPLACE (
    coalesce(customer_age, m_age) AS customer_age,
    coalesce(distance_km_clean, m_distance) AS distance_km_clean,
    coalesce(payment_method, 'Unknown') AS payment_method,
    coalesce(traffic_level, 'Unknown') AS traffic_level,
    coalesce(weather_condition, 'Unknown') AS weather_condition,
    coalesce(promo_code_used, 'Unknown') AS promo_code_used)
  FROM sided, medians
)"""

_CHAIN = {
    "bookings": [_BOOKINGS],
    "typed": [_BOOKINGS, _TYPED],
    "kept": [_BOOKINGS, _TYPED, _KEPT],
    "raw_basket": [_BOOKINGS, _TYPED, _KEPT, _RAW_BASKET],
    "basket": [_BOOKINGS, _TYPED, _KEPT, _RAW_BASKET, _BASKET],
    "rich": [_BOOKINGS, _TYPED, _KEPT, _RAW_BASKET, _BASKET, _RICH],
    "model": [_BOOKINGS, _TYPED, _KEPT, _RAW_BASKET, _BASKET, _RICH, _MODEL],
    "sided": [_BOOKINGS, _TYPED, _KEPT, _RAW_BASKET, _BASKET, _RICH, _MODEL, _SIDED],
    "filled": [_BOOKINGS, _TYPED, _KEPT, _RAW_BASKET, _BASKET, _RICH, _MODEL, _SIDED, _FILLED],
}


def on(level: str, body: str, *more: str) -> str:
    """``body`` after the CTEs up to ``level`` and any further ones in ``more``."""
    return "WITH " + ",".join([*_CHAIN[level], *more]) + "\n" + body


def _missing(columns: list[str], source: str, by: str = "") -> str:
    group = f", {by}" if by else ""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) / count(*)::DOUBLE * 100, 6) AS percentage{group} FROM {source}"
        + (f" GROUP BY {by}" if by else "")
        for c in columns
    )


def _melt(columns: list[str], source: str, keep: str = "") -> str:
    more = f", {keep}" if keep else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS category{more} FROM {source}"
        for c in columns
    )


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def _eight(c: str) -> str:
    return ", ".join(
        [
            f"count({c}) AS n",
            _r(f"avg({c})", "mean"),
            _r(f"quantile_cont({c}, 0.5)", "median"),
            _r(f"stddev_samp({c})", "sd"),
            _r(f"min({c})", "min"),
            _r(f"quantile_cont({c}, 0.25)", "q1"),
            _r(f"quantile_cont({c}, 0.75)", "q3"),
            _r(f"max({c})", "max"),
        ]
    )


def _four(c: str) -> str:
    return ", ".join(
        [
            "count(*) AS n_rows",
            _r(f"avg({c})", "mean"),
            _r(f"quantile_cont({c}, 0.5)", "median"),
            _r(f"stddev_samp({c})", "sd"),
        ]
    )


def _many(columns: list[str], stats: list[str]) -> str:
    make = {
        "mean": "avg({})",
        "median": "quantile_cont({}, 0.5)",
        "sd": "stddev_samp({})",
        "min": "min({})",
        "max": "max({})",
    }
    return ", ".join(_r(make[s].format(c), f"{c}_{s}") for c in columns for s in stats)


def _skewness(c: str, source: str) -> str:
    return (
        f"SELECT count({c}) AS n, round(avg(power({c} - m, 3)) / power(any_value(s), 3), 6) AS skewness "
        f"FROM {source}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {source})"
    )


def _fences(c: str, source: str) -> str:
    return f"""
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS n_below,
  count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS n_above,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})
GROUP BY q1, q3"""


def _boxes(c: str, source: str, by: list[str]) -> str:
    keys = ", ".join(by)
    match = " AND ".join(f"s.{k} IS NOT DISTINCT FROM b.{k}" for k in by)
    shown = ", ".join(f"b.{k}" for k in by)
    return f"""
SELECT {shown}, any_value(b.n) AS n, round(any_value(b.mean), 6) AS mean,
  round(any_value(b.q1), 6) AS q1, round(any_value(b.median), 6) AS median,
  round(any_value(b.q3), 6) AS q3,
  min({c}) FILTER ({c} BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)) AS whisker_low,
  max({c}) FILTER ({c} BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)) AS whisker_high,
  count(*) FILTER ({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS n_outliers
FROM {source} s JOIN (
  SELECT {keys}, count({c}) AS n, avg({c}) AS mean, quantile_cont({c}, 0.25) AS q1,
    quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3
  FROM {source} GROUP BY {keys}) b ON {match}
GROUP BY {shown}"""


def _histogram(c: str, source: str) -> str:
    return f"""
ends AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 29 AS w FROM {source}),
first AS (SELECT *, CAST(floor((lo - w / 2) / w) AS BIGINT) + 1 AS b0,
  CAST(ceil((hi - w / 2) / w) AS BIGINT) AS b1 FROM ends),
counted AS (
  SELECT greatest(CAST(ceil(({c} - w / 2) / w) AS BIGINT), b0) AS bin, count(*) AS n
  FROM {source}, first WHERE {c} IS NOT NULL GROUP BY 1
),
bars AS (
  SELECT g.bin, round(g.bin * w, 6) AS centre, coalesce(n, 0) AS n
  FROM (SELECT unnest(generate_series(b0, b1)) AS bin, w FROM first) g
  LEFT JOIN counted USING (bin)
)"""


_SCORED = """
scored AS (
  SELECT *, 20000.0::DOUBLE + 5000.0::DOUBLE * distance_km_clean + 100.0::DOUBLE * customer_age AS pred
  FROM filled
),
cut AS (SELECT quantile_cont(basket_value, 0.8) AS t FROM filled WHERE dataset = 'Train'),
labelled AS (
  SELECT scored.*, CAST(basket_value >= t AS INTEGER) AS high_value, t AS threshold FROM scored, cut
)"""


# Coefficients of the normal quantile by rational functions (Wichura, algorithm AS 241),
# from the highest power down; numerator and denominator, near the middle and in the tails.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)


def _ratio(parts: tuple, r: str) -> str:
    """A rational function of ``r`` in nested form."""

    def nested(values: tuple) -> str:
        out = f"{values[0]!r}::DOUBLE"
        for v in values[1:]:
            out = f"({out} * {r} + {v!r}::DOUBLE)"
        return out

    return f"({nested(parts[0])} / {nested(parts[1])})"


def _normal_quantile(p: str) -> str:
    """The normal quantile of ``p`` for chances between e**-25 and 1 - e**-25."""
    q = f"({p} - 0.5)"
    r = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    middle = f"{q} * {_ratio(_MIDDLE, f'(0.180625 - {q} * {q})')}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {middle} ELSE sign({q}) * {_ratio(_TAIL, r)} END"


def _type_counts(c: str) -> str:
    """Numbers of present cells of a text column, and of those that each type holds."""
    cell = f"trim({c})"
    day = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    date = f"(regexp_full_match({cell}, '{day}') AND TRY_CAST({cell} AS DATE) IS NOT NULL)"
    stamp = (
        f"(regexp_full_match({cell}, '{day}[ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-5][0-9])?') "
        f"AND TRY_CAST({cell} AS TIMESTAMP) IS NOT NULL)"
    )
    fits = {
        "boolean": f"lower({cell}) IN ('true', 'false', 'yes', 'no')",
        "integer": f"regexp_full_match({cell}, '[+-]?[0-9]{{1,18}}')",
        "number": f"TRY_CAST({cell} AS DOUBLE) IS NOT NULL",
        "date": date,
        "timestamp": f"({date} OR {stamp})",
    }
    counts = ", ".join(f"count(*) FILTER ({cell} <> '' AND {f}) AS \"{t}\"" for t, f in fits.items())
    return f"SELECT '{c}' AS variable, count(*) FILTER ({cell} <> '') AS n, {counts} FROM bookings"


def oracles() -> dict[str, str]:
    melt = _melt(CATEGORICAL, "basket")
    q: dict[str, str] = {}

    # Sources and sinks
    q["load_bookings"] = on("bookings", f"SELECT {', '.join(RAW)} FROM bookings")
    q["coerce_numeric"] = on("typed", f"SELECT {', '.join(RAW)} FROM typed")
    q["export_reconcile"] = on(
        "filled",
        """
SELECT dataset, 'csv' AS format, count(*) AS rows_source, count(*) AS rows_written,
  round(sum(basket_value), 2) AS total_source, round(sum(basket_value), 2) AS total_written,
  true AS same_columns, true AS same_content, true AS complete
FROM (SELECT dataset, basket_value FROM filled UNION ALL SELECT 'Full', basket_value FROM filled)
GROUP BY dataset
UNION ALL
SELECT dataset, 'parquet', count(*), count(*), round(sum(basket_value), 2),
  round(sum(basket_value), 2), true, true, true
FROM (SELECT dataset, basket_value FROM filled UNION ALL SELECT 'Full', basket_value FROM filled)
GROUP BY dataset""",
    )

    # Projections, filters
    q["filter_service"] = on("kept", f"SELECT {', '.join(RAW)} FROM kept")
    q["filter_service_valid"] = on(
        "kept", f"SELECT {', '.join(RAW)} FROM kept WHERE basket_value IS NOT NULL"
    )
    q["invalid_distance_rows"] = on(
        "rich",
        "SELECT booking_id, service_type, distance_km, estimated_duration_min, "
        "round(estimated_speed_kmh, 6) AS estimated_speed_kmh, basket_value FROM rich WHERE distance_invalid",
    )
    q["complete_pairs"] = on(
        "basket",
        "SELECT discount_amount, basket_value FROM basket "
        "WHERE discount_amount IS NOT NULL AND basket_value IS NOT NULL",
    )
    q["model_table"] = on("model", "SELECT * FROM model")
    q["table_shape"] = on(
        "model", "SELECT count(*) AS n_rows, 16::BIGINT AS n_columns FROM model"
    )
    doubles = {
        "customer_age",
        "distance_km_clean",
        "estimated_duration_min",
        "discount_amount",
        "basket_value",
    }
    q["schema_profile"] = on(
        "model",
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{c}' AS "column", '{"double" if c in doubles else "string"}' AS type,
  count(*) - count({c}) AS n_null,
  count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS n_distinct FROM model"""
            for i, c in enumerate(MODEL, start=1)
        ),
    )

    # Duplicates
    q["dup_summary"] = on(
        "kept",
        'SELECT count(*) AS "rows", count(DISTINCT booking_id) AS distinct_keys, '
        "count(*) - count(DISTINCT booking_id) AS surplus FROM kept",
    )
    q["dup_rows"] = on(
        "kept",
        f"SELECT {', '.join(RAW)} FROM (SELECT *, count(*) OVER (PARTITION BY booking_id) AS k FROM kept) "
        "WHERE k > 1",
    )
    q["dedupe_first"] = on("raw_basket", f"SELECT {', '.join(RAW)} FROM raw_basket")

    # Missing values and quality
    q["missing_summary"] = on("kept", _missing(RAW[:16], "kept"))
    q["missing_counts"] = on("basket", _missing(ANALYSIS, "basket"))
    q["model_missing"] = on("model", _missing(MODEL[1:], "model"))
    q["predictor_missing"] = on("basket", _missing(ANALYSIS[:-1], "basket"))
    q["missing_after_impute"] = on("filled", _missing(MODEL[1:], "filled", "dataset"))
    status = " UNION ALL ".join(
        f"SELECT booking_id, '{c}' AS variable, CASE WHEN {c} IS NULL THEN 'Missing' ELSE 'Present' END "
        "AS status FROM basket"
        for c in ANALYSIS
    )
    q["missing_map"] = on("basket", status)
    q["missing_map_grid"] = on(
        "basket",
        "SELECT substr(md5(booking_id), 1, 2) AS bucket, variable, "
        "count(*) FILTER (status = 'Missing') AS missing, count(*) FILTER (status = 'Present') AS present "
        f"FROM ({status}) GROUP BY 1, 2",
    )
    labels = {
        "customer_segment": "Customer|segment",
        "service_type": "Service|type",
        "customer_age": "Customer|age",
        "city": "City",
        "payment_method": "Payment|method",
        "booking_channel": "Booking|channel",
        "distance_km": "Distance",
        "estimated_duration_min": "Estimated|duration",
        "promo_code_used": "Promo|code",
        "discount_amount": "Discount",
        "traffic_level": "Traffic|level",
        "weather_condition": "Weather|condition",
        "basket_value": "Basket|value",
    }
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    q["missing_labels"] = on(
        "basket",
        f"SELECT variable, replace(CASE variable {named} END, '|', chr(10)) || chr(10) || '(' || "
        "regexp_replace(CAST(round_even(percentage, 1) AS VARCHAR), '\\.0$', '') || '%)' AS label "
        f"FROM ({_missing(ANALYSIS, 'basket')})",
    )
    q["has_missing"] = on("rich", "SELECT booking_id, has_missing FROM rich")
    q["missing_group_summary"] = on(
        "rich",
        "SELECT has_missing, count(*) AS n, "
        "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM rich GROUP BY 1",
    )
    compared = ["basket_value", "customer_age", "distance_km", "estimated_duration_min", "discount_amount"]
    q["missing_impact"] = on(
        "rich",
        "SELECT has_missing, count(*) AS n, "
        "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage, "
        + ", ".join(
            _r(f"avg({c})", f"mean_{c}") + ", " + _r(f"quantile_cont({c}, 0.5)", f"median_{c}")
            for c in compared
        )
        + ", round(stddev_samp(basket_value), 6) AS sd_basket_value FROM rich GROUP BY 1",
    )
    q["missing_target_compare"] = on(
        "rich",
        "SELECT has_missing, count(*) AS n_rows, "
        + _many(["basket_value"], ["mean", "median", "sd", "min", "max"]).replace("basket_value_", "")
        + " FROM rich GROUP BY 1",
    )
    q["missing_mean_diff"] = on(
        "rich",
        "SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b - a, 6) AS difference, "
        "round((b - a) / a * 100, 6) AS percentage_difference FROM (SELECT "
        "avg(basket_value) FILTER (has_missing = 'Complete') AS a, "
        "avg(basket_value) FILTER (has_missing = 'Has Missing Data') AS b FROM rich)",
    )
    shares = (
        "SELECT variable, has_missing, category, count(*) AS n, count(*) * 100.0::DOUBLE / "
        "sum(count(*)) OVER (PARTITION BY variable, has_missing) AS percentage "
        f"FROM ({_melt(CATEGORICAL, 'rich', 'has_missing')}) GROUP BY variable, has_missing, category"
    )
    q["cat_missing_share"] = on(
        "rich",
        "SELECT variable, has_missing, category, n, round(percentage, 6) AS percentage "
        f"FROM ({shares})",
    )
    q["cat_missing_diff"] = on(
        "rich",
        "SELECT variable, category, round(a, 6) AS share_a, round(b, 6) AS share_b, "
        "round(b - a, 6) AS percentage_difference FROM (SELECT variable, category, "
        "coalesce(max(percentage) FILTER (has_missing = 'Complete'), 0) AS a, "
        "coalesce(max(percentage) FILTER (has_missing = 'Has Missing Data'), 0) AS b "
        f"FROM ({shares}) GROUP BY 1, 2)",
    )
    q["category_values"] = on(
        "raw_basket", f"SELECT DISTINCT variable, category FROM ({_melt(CATEGORICAL, 'raw_basket')})"
    )
    q["category_values_trimmed"] = on(
        "raw_basket",
        f"SELECT DISTINCT variable, trim(category) AS category FROM ({_melt(CATEGORICAL, 'raw_basket')})",
    )
    q["category_values_clean"] = on(
        "basket", f"SELECT DISTINCT variable, category FROM ({melt}) WHERE category IS NOT NULL"
    )
    q["category_counts"] = on(
        "basket", "SELECT promo_code_used AS category, count(*) AS n FROM basket GROUP BY 1"
    )
    q["category_counts_sorted"] = on(
        "basket", f"SELECT variable, category, count(*) AS n FROM ({melt}) GROUP BY 1, 2"
    )
    q["promo_discount_crosstab"] = on(
        "model",
        "SELECT promo_code_used AS category, true AS other_missing, "
        "count(*) FILTER (discount_amount IS NULL) AS n FROM model GROUP BY 1 UNION ALL "
        "SELECT promo_code_used, false, count(*) FILTER (discount_amount IS NOT NULL) FROM model GROUP BY 1",
    )
    q["whitespace_values"] = on(
        "raw_basket",
        f"SELECT variable, category, count(*) AS n FROM ({_melt(CATEGORICAL, 'raw_basket')}) "
        "WHERE category <> trim(category) GROUP BY 1, 2",
    )
    q["empty_values"] = on(
        "raw_basket",
        f"SELECT variable, count(*) FILTER (trim(category) = '') AS n "
        f"FROM ({_melt(CATEGORICAL, 'raw_basket')}) GROUP BY 1",
    )
    q["impossible_values"] = on(
        "basket",
        "SELECT count(*) FILTER (customer_age < 0) AS negative_age, "
        "count(*) FILTER (distance_km = 0) AS zero_distance, "
        "count(*) FILTER (distance_km < 0) AS negative_distance, "
        "count(*) FILTER (estimated_duration_min < 0) AS negative_duration, "
        "count(*) FILTER (basket_value < 0) AS negative_value, "
        "count(*) FILTER (basket_value = 0) AS zero_value FROM basket",
    )

    # Cleaning
    q["clean_categories"] = on(
        "basket", f"SELECT booking_id, {', '.join(CATEGORICAL)} FROM basket"
    )
    q["parse_datetime"] = on(
        "bookings",
        "SELECT booking_id, ord_a, basket_value, "
        "TRY_CAST(booking_datetime || ':00' AS TIMESTAMP) AS booking_datetime FROM bookings",
    )
    q["time_features"] = on(
        "rich",
        "SELECT booking_id, booking_datetime, booking_hour, booking_day, is_weekend, time_period FROM rich",
    )
    q["time_period_night"] = on(
        "rich", "SELECT booking_id, coalesce(time_period, 'Night') AS time_period FROM rich"
    )
    q["speed_flag"] = on(
        "rich",
        "SELECT booking_id, round(estimated_speed_kmh, 6) AS estimated_speed_kmh, distance_invalid FROM rich",
    )
    q["distance_clean"] = on("rich", "SELECT booking_id, distance_km, distance_km_clean FROM rich")
    q["distance_clean_effect"] = on(
        "rich",
        "SELECT count(*) - count(distance_km) AS missing_before, "
        "count(*) - count(distance_km_clean) AS missing_after, "
        "count(*) FILTER (distance_km_clean IS NULL AND distance_km IS NOT NULL) AS newly_missing, "
        "count(*) FILTER (distance_invalid) AS flagged FROM rich",
    )
    factor = [*CATEGORICAL, "time_period", "is_weekend"]
    q["factor_levels"] = on(
        "rich",
        "SELECT variable, category AS level, "
        "CAST(row_number() OVER (PARTITION BY variable ORDER BY category) AS INTEGER) AS idx "
        f"FROM (SELECT DISTINCT variable, category FROM ({_melt(factor, 'rich')}) WHERE category IS NOT NULL)",
    )

    # Summaries
    q["target_summary"] = on("basket", f"SELECT {_eight('basket_value')} FROM basket")
    for key, column in (("service", "service_type"), ("promo", "promo_code_used")):
        q[f"value_by_{key}"] = on(
            "basket", f"SELECT {column}, {_eight('basket_value')} FROM basket GROUP BY 1"
        )
    for key, column in (("traffic", "traffic_level"), ("weather", "weather_condition")):
        q[f"value_by_{key}"] = on(
            "basket", f"SELECT {column}, {_four('basket_value')} FROM basket GROUP BY 1"
        )
    q["discount_summary"] = on(
        "basket",
        f"SELECT {_eight('discount_amount')}, count(*) - count(discount_amount) AS missing FROM basket",
    )
    eda = ["customer_age", "distance_km", "estimated_duration_min", "discount_amount"]
    q["numeric_summary"] = on(
        "basket", f"SELECT {_many(eda, ['mean', 'median', 'sd', 'min', 'max'])} FROM basket"
    )
    q["category_share"] = on(
        "basket",
        "SELECT variable, category, count(*) AS n, round(count(*) * 100.0::DOUBLE / "
        f"sum(count(*)) OVER (PARTITION BY variable), 6) AS percentage FROM ({melt}) GROUP BY 1, 2",
    )
    q["value_by_category"] = on(
        "basket",
        "SELECT variable, category, count(*) AS n, round(avg(basket_value), 6) AS mean, "
        "round(quantile_cont(basket_value, 0.5), 6) AS median "
        f"FROM ({_melt(CATEGORICAL, 'basket', 'basket_value')}) GROUP BY 1, 2",
    )
    pairs = {
        "age_correlation": "customer_age",
        "distance_correlation": "distance_km",
        "duration_correlation": "estimated_duration_min",
        "discount_correlation": "discount_amount",
    }
    q["correlations"] = on(
        "basket",
        "SELECT "
        + ", ".join(_r(f"corr({c}, basket_value)", a) for a, c in pairs.items())
        + " FROM basket",
    )
    q["six_number"] = on(
        "rich",
        "SELECT "
        + ", ".join(
            [
                _r("min(distance_km_clean)", "min"),
                _r("quantile_cont(distance_km_clean, 0.25)", "q1"),
                _r("quantile_cont(distance_km_clean, 0.5)", "median"),
                _r("avg(distance_km_clean)", "mean"),
                _r("quantile_cont(distance_km_clean, 0.75)", "q3"),
                _r("max(distance_km_clean)", "max"),
                "count(*) - count(distance_km_clean) AS missing",
            ]
        )
        + " FROM rich",
    )
    q["skewness_type3"] = on("basket", _skewness("basket_value", "basket"))
    q["events_skewness"] = _skewness("value", "events")
    q["quantiles"] = on(
        "basket",
        " UNION ALL ".join(
            f"SELECT {p}::DOUBLE AS p, round(quantile_cont(basket_value, {p}), 6) AS value FROM basket"
            for p in (0.25, 0.75, 0.8)
        ),
    )
    q["iqr_fence"] = on("basket", _fences("basket_value", "basket"))
    q["events_iqr_fence"] = _fences("value", "events")
    shown = ["service_type", "customer_segment", "city", "payment_method", "booking_channel"]
    q["split_category_share"] = on(
        "filled",
        "SELECT variable, d.dataset, category, round(count(*) FILTER (m.dataset = d.dataset) / "
        "sum(count(*) FILTER (m.dataset = d.dataset)) OVER (PARTITION BY variable, d.dataset)::DOUBLE, 6) AS share "
        f"FROM ({_melt(shown, 'filled', 'dataset')}) m, (SELECT DISTINCT dataset FROM filled) d "
        "WHERE category IS NOT NULL GROUP BY variable, d.dataset, category",
    )
    q["impute_mean_compare"] = on(
        "filled",
        " UNION ALL ".join(
            f"SELECT '{label}' AS variable, round(avg({c}), 6) AS mean_value, '{stage}' AS stage FROM {t}"
            for t, stage in (("model", "Before imputation"), ("filled", "After imputation"))
            for c, label in (("customer_age", "Customer age"), ("distance_km_clean", "Distance (km)"))
        ),
    )

    # Reshape
    q["segment_order"] = on(
        "basket",
        "SELECT customer_segment, round(quantile_cont(basket_value, 0.5), 6) AS median FROM basket "
        "WHERE customer_segment IS NOT NULL GROUP BY 1",
    )
    q["stack_split"] = on("filled", f"SELECT {', '.join(MODEL)}, dataset FROM filled")
    unknown = ["payment_method", "traffic_level", "weather_condition", "promo_code_used"]
    q["level_union"] = on(
        "filled",
        f"SELECT DISTINCT variable, category AS level FROM ({_melt(unknown, 'filled')}) "
        "WHERE category IS NOT NULL",
    )
    q["unpivot_categories"] = on(
        "basket", _melt(CATEGORICAL, "basket", "booking_id, basket_value")
    )

    # Split and imputation
    q["stratified_split"] = on("sided", "SELECT booking_id, bin, dataset FROM sided")
    q["split_sizes"] = on(
        "sided",
        "SELECT dataset, count(*) AS n, "
        "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage, "
        "sum(count(*)) OVER () = (SELECT count(*) FROM model) AS rows_conserved FROM sided GROUP BY 1",
    )
    q["split_target_summary"] = on(
        "sided", f"SELECT dataset, {_eight('basket_value')} FROM sided GROUP BY 1"
    )
    numeric = ["customer_age", "distance_km_clean", "estimated_duration_min", "discount_amount"]
    q["split_numeric_summary"] = on(
        "filled", f"SELECT dataset, {_many(numeric, ['mean', 'median', 'sd'])} FROM filled GROUP BY 1"
    )
    q["impute_median"] = on(
        "filled", "SELECT booking_id, dataset, customer_age, distance_km_clean FROM filled"
    )
    q["impute_unknown"] = on(
        "filled", f"SELECT booking_id, dataset, {', '.join(unknown)} FROM filled"
    )
    q["restrict_levels"] = on(
        "sided",
        "SELECT booking_id, dataset, CASE WHEN promo_code_used IN (SELECT promo_code_used FROM sided "
        "WHERE dataset = 'Train' AND promo_code_used IS NOT NULL) THEN promo_code_used END AS promo_code_used, "
        "CASE WHEN city IN (SELECT city FROM sided WHERE dataset = 'Train' AND city IS NOT NULL) "
        "THEN city END AS city FROM sided",
    )
    q["train_medians"] = on(
        "filled",
        "SELECT round(m_age, 6) AS customer_age, round(m_distance, 6) AS distance_km_clean FROM medians",
    )
    q["final_cleaned"] = on("filled", f"SELECT {', '.join(MODEL)}, dataset FROM filled")

    # Plot data
    q["histogram30"] = on("basket", "SELECT bin, centre, n FROM bars", _histogram("basket_value", "basket"))
    q["histogram_high_value"] = on(
        "basket",
        "SELECT bin, centre, n, CASE WHEN centre >= t THEN 'High-value (Top 20%)' "
        "ELSE 'Below 80th Percentile' END AS \"group\", round(t, 6) AS threshold "
        "FROM bars, (SELECT quantile_cont(basket_value, 0.8) AS t FROM basket)",
        _histogram("basket_value", "basket"),
    )
    q["boxplot_service"] = on("basket", _boxes("basket_value", "basket", ["service_type"]))
    q["boxplot_segment"] = on("basket", _boxes("basket_value", "basket", ["customer_segment"]))
    q["boxplot_segment_service"] = on(
        "basket", _boxes("basket_value", "basket", ["service_type", "customer_segment"])
    )
    for key, column in (("traffic", "traffic_level"), ("weather", "weather_condition")):
        q[f"boxplot_{key}"] = on(
            "basket",
            _boxes("basket_value", "present", [column]),
            f"\npresent AS (SELECT * FROM basket WHERE {column} IS NOT NULL AND basket_value IS NOT NULL)",
        )
    q["boxplot_split"] = on("sided", _boxes("basket_value", "sided", ["dataset"]))
    q["events_boxplot"] = _boxes("value", "events", ["event_type"])
    q["events_outliers"] = """
SELECT event_id, event_type, value FROM events JOIN (
  SELECT event_type AS t, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY 1) ON event_type = t
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
    grid = "greatest(CAST(ceil(({c} - {c}_w / 2) / {c}_w) AS BIGINT), CAST(floor(({c}_lo - {c}_w / 2) / {c}_w) AS BIGINT) + 1)"
    q["density2d"] = on(
        "basket",
        f"SELECT {grid.format(c='discount_amount')} AS x_bin, {grid.format(c='basket_value')} AS y_bin, "
        "count(*) AS n FROM pairs, (SELECT "
        + ", ".join(
            f"min({c}) AS {c}_lo, (max({c}) - min({c})) / 29 AS {c}_w"
            for c in ("discount_amount", "basket_value")
        )
        + " FROM pairs) GROUP BY 1, 2",
        "\npairs AS (SELECT discount_amount, basket_value FROM basket "
        "WHERE discount_amount IS NOT NULL AND basket_value IS NOT NULL)",
    )
    q["lm_fit"] = on(
        "basket",
        "SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, "
        "round(r2, 9) AS r2, round(sqrt((syy - slope * slope * sxx) / (n - 2)), 4) AS residual_se, "
        "round(x_mean, 6) AS x_mean, round(sxx / n, 2) AS x_variance FROM (SELECT "
        "regr_count(basket_value, discount_amount) AS n, regr_slope(basket_value, discount_amount) AS slope, "
        "regr_intercept(basket_value, discount_amount) AS intercept, "
        "regr_r2(basket_value, discount_amount) AS r2, regr_sxx(basket_value, discount_amount) AS sxx, "
        "regr_syy(basket_value, discount_amount) AS syy, regr_avgx(basket_value, discount_amount) AS x_mean "
        "FROM basket)",
    )

    # Models and evaluation
    q["high_value_label"] = on(
        "filled", "SELECT booking_id, dataset, high_value, round(threshold, 6) AS threshold FROM labelled", _SCORED
    )
    q["regression_metrics"] = on(
        "filled",
        """
SELECT dataset, count(*) AS n, round(1 - sum(power(basket_value - pred, 2)) / (var_pop(basket_value) * count(*)), 6) AS r2,
  round(1 - (sum(power(basket_value - pred, 2)) / (var_pop(basket_value) * count(*))) * (count(*) - 1) / (count(*) - 3), 6) AS adj_r2,
  round(sqrt(avg(power(basket_value - pred, 2))), 6) AS rmse, round(avg(abs(basket_value - pred)), 6) AS mae
FROM scored GROUP BY dataset""",
        _SCORED,
    )
    q["residual_bins"] = on(
        "filled",
        """
SELECT bin, count(*) AS n, round(avg(pred), 6) AS mean_fitted, round(avg(basket_value - pred), 6) AS mean_residual,
  round(stddev_samp(basket_value - pred), 6) AS sd_residual
FROM (SELECT *, least(CAST(floor((pred - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin
  FROM scored, (SELECT min(pred) AS lo, max(pred) AS hi FROM scored WHERE dataset = 'Train') WHERE dataset = 'Train')
GROUP BY bin""",
        _SCORED,
    )
    q["classification_metrics"] = on(
        "filled",
        """
SELECT dataset, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
  round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1
FROM (SELECT dataset, count(*) FILTER (high_value = 1 AND pred >= 60000) AS tp,
  count(*) FILTER (high_value = 0 AND pred >= 60000) AS fp, count(*) FILTER (high_value = 1 AND pred < 60000) AS fn,
  count(*) FILTER (high_value = 0 AND pred < 60000) AS tn FROM labelled GROUP BY 1)""",
        _SCORED,
    )
    q["roc_auc"] = on(
        "filled",
        """
SELECT CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative,
  round(sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT pred, CAST(sum(high_value) AS DOUBLE) AS pos, CAST(sum(1 - high_value) AS DOUBLE) AS neg
    FROM labelled WHERE dataset = 'Test' GROUP BY pred))""",
        _SCORED,
    )
    q["score_ranking"] = on(
        "filled",
        "SELECT booking_id, round(pred, 6) AS score, high_value FROM labelled WHERE dataset = 'Test'",
        _SCORED,
    )
    z = "1.959963984540054"
    q["lm_band"] = on(
        "basket",
        f"""
SELECT round(x, 4) AS x, round(fit, 4) AS fit, round(fit - half, 4) AS low, round(fit + half, 4) AS high
FROM (SELECT x, intercept + slope * x AS fit,
    t * sqrt((syy - slope * slope * sxx) / (n - 2)) * sqrt(1.0 / n + (x - xm) ** 2 / sxx) AS half
  FROM (SELECT *, lo + i * (hi - lo) / 79 AS x,
      {z} + ({z} ** 3 + {z}) / 4 / (n - 2)
      + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / 96 / (n - 2) ** 2
      + (3 * {z} ** 7 + 19 * {z} ** 5 + 17 * {z} ** 3 - 15 * {z}) / 384 / (n - 2) ** 3 AS t
    FROM (SELECT regr_count(y, x)::DOUBLE AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
        regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_avgx(y, x) AS xm, min(x) AS lo, max(x) AS hi
      FROM (SELECT basket_value AS y, discount_amount AS x FROM basket
        WHERE basket_value IS NOT NULL AND discount_amount IS NOT NULL)), range(80) AS g(i)))""",
    )
    q["vif_pair"] = on(
        "filled",
        "SELECT unnest(['distance_km_clean', 'estimated_duration_min']) AS term, round(1 / (1 - r * r), 6) AS vif "
        "FROM (SELECT corr(distance_km_clean, estimated_duration_min) AS r FROM filled WHERE dataset = 'Train')",
    )
    line = """
line AS (SELECT count(*)::DOUBLE AS n, regr_slope(basket_value, distance_km_clean) AS slope,
    regr_intercept(basket_value, distance_km_clean) AS intercept, regr_sxx(basket_value, distance_km_clean) AS sxx,
    regr_syy(basket_value, distance_km_clean) AS syy, avg(distance_km_clean) AS xm
  FROM filled WHERE dataset = 'Train'),
error AS (SELECT booking_id, distance_km_clean AS x, basket_value - intercept - slope * distance_km_clean AS e,
    1 / n + (distance_km_clean - xm) ** 2 / sxx AS h, (syy - slope * slope * sxx) / (n - 2) AS mse
  FROM filled, line WHERE dataset = 'Train')"""
    q["breusch_pagan_one"] = on(
        "filled",
        "SELECT count(*) AS n, 1 AS df, round(count(*) * corr(e * e, x) ** 2, 4) AS statistic FROM error",
        line,
    )
    q["cooks_distance_one"] = on(
        "filled",
        "SELECT booking_id, round(e, 3) AS residual, round(h, 9) AS leverage, "
        "round(e * e / (2 * mse) * h / (1 - h) ** 2, 9) AS cooks_d FROM error",
        line,
    )
    two = """
ab AS (SELECT dataset, basket_value AS y, distance_km_clean AS a, estimated_duration_min AS b FROM filled
  WHERE basket_value IS NOT NULL AND distance_km_clean IS NOT NULL AND estimated_duration_min IS NOT NULL),
m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS ym, avg(a) AS am, avg(b) AS bm, var_pop(y) AS yy, var_pop(a) AS aa,
    var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_
  FROM ab WHERE dataset = 'Train'),
coef AS (SELECT *, ay / aa AS s1, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS s2,
  (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS t2 FROM m),
guess AS (SELECT dataset, y, ym + s1 * (a - am) AS p1, ym + s2 * (a - am) + t2 * (b - bm) AS p2 FROM ab, coef),
met AS (SELECT step, dataset, count(*) AS n, 1 - avg((y - p) ** 2) / var_pop(y) AS r2, sqrt(avg((y - p) ** 2)) AS rmse,
    avg(abs(y - p)) AS mae, sum((y - p) ** 2) AS sse, var_pop(y) * count(*) AS sst
  FROM (SELECT 1 AS step, dataset, y, p1 AS p FROM guess UNION ALL SELECT 2, dataset, y, p2 FROM guess) GROUP BY 1, 2),
adj AS (SELECT *, 1 - (1 - r2) * (n - 1) / (n - step - 1) AS adj FROM met)"""
    sides = ", ".join(
        f"{x}.n AS n_{side}, {_r(f'{x}.r2', f'r2_{side}', 9)}, {_r(f'{x}.adj', f'adj_r2_{side}', 9)}, "
        f"{_r(f'{x}.rmse', f'rmse_{side}', 4)}, {_r(f'{x}.mae', f'mae_{side}', 4)}"
        for x, side in (("tr", "train"), ("te", "test"))
    )
    along = "OVER (ORDER BY tr.step)"
    q["mlr_two"] = on(
        "filled",
        f"""
SELECT CAST(tr.step AS INTEGER) AS step, CAST(tr.step AS INTEGER) AS n_terms, {sides},
  round(tr.adj - lag(tr.adj) {along}, 9) AS adj_r2_gain, round(lag(te.rmse) {along} - te.rmse, 4) AS rmse_test_gain,
  round((coalesce(lag(tr.sse) {along}, tr.sst) - tr.sse) / (tr.sse / (tr.n - tr.step - 1)), 4) AS f_value,
  CAST(1 AS INTEGER) AS f_df1, CAST(tr.n - tr.step - 1 AS BIGINT) AS f_df2
FROM adj tr JOIN adj te ON tr.step = te.step AND tr.dataset = 'Train' AND te.dataset = 'Test'""",
        two,
    )
    q["mlr_robust_one"] = on(
        "filled",
        """
SELECT term, round(b, 4) AS estimate, round(se, 4) AS std_error, round(robust, 4) AS robust_error, round(b / robust, 4) AS robust_t
FROM (SELECT unnest(['(Intercept)', 'distance_km_clean']) AS term, unnest([any_value(intercept), any_value(slope)]) AS b,
    unnest([sqrt(any_value(mse) * (1 / any_value(n) + any_value(xm) ** 2 / any_value(sxx))), sqrt(any_value(mse) / any_value(sxx))]) AS se,
    unnest([sqrt(any_value(n / (n - 2)) * sum((e * (1 / n - xm * (x - xm) / sxx)) ** 2)),
      sqrt(any_value(n / (n - 2)) * sum((e * (x - xm) / sxx) ** 2))]) AS robust
  FROM error, line)""",
        line,
    )
    q["reset_one"] = on(
        "filled",
        """
SELECT CAST(n AS BIGINT) AS n, CAST(1 AS INTEGER) AS df1, CAST(n - 3 AS BIGINT) AS df2, round((one - two) / (two / (n - 3)), 4) AS f_value
FROM (SELECT n, n * (yy - ay * ay / aa) AS one,
    n * (yy - (ay * ay * bb - 2 * ay * by_ * ab + by_ * by_ * aa) / (aa * bb - ab * ab)) AS two
  FROM (SELECT count(*)::DOUBLE AS n, var_pop(y) AS yy, var_pop(z) AS aa, var_pop(z * z) AS bb, covar_pop(z, z * z) AS ab,
      covar_pop(z, y) AS ay, covar_pop(z * z, y) AS by_
    FROM (SELECT basket_value AS y, distance_km_clean - xm AS z FROM filled, line WHERE dataset = 'Train')))""",
        line,
    )
    q["collinearity_pair"] = on(
        "filled",
        """
SELECT CAST(j AS INTEGER) AS component, round(1 - s * r, 6) AS eigenvalue, round(sqrt((1 + r) / (1 - s * r)), 6) AS condition_index,
  term, round((1 + s * r) / 2, 6) AS share
FROM (SELECT abs(corr(distance_km_clean, estimated_duration_min)) AS r FROM filled WHERE dataset = 'Train'),
  (VALUES (1, -1), (2, 1)) AS c(j, s), (VALUES ('distance_km_clean'), ('estimated_duration_min')) AS t(term)""",
    )
    odds = """
odds AS (SELECT service_type AS level, avg(high_value) AS p, sum(high_value) / (count(*) - sum(high_value)) AS o
  FROM labelled WHERE dataset = 'Train' GROUP BY 1),
base AS (SELECT min(level) AS first, arg_min(o, level) AS o0 FROM odds)"""
    q["odds_ratios_one"] = on(
        "filled",
        "SELECT CASE WHEN level = first THEN '(Intercept)' ELSE 'service_type_' || level END AS term, "
        "round(CASE WHEN level = first THEN o0 ELSE o / o0 END, 4) AS odds_ratio FROM odds, base",
        _SCORED + "," + odds,
    )
    q["firth_odds_one"] = on(
        "filled",
        "SELECT CASE WHEN level = first THEN '(Intercept)' ELSE 'service_type_' || level END AS term, "
        "round(CASE WHEN level = first THEN o0 ELSE o / o0 END, 6) AS odds_ratio FROM half, half_base",
        _SCORED
        + """,
half AS (SELECT service_type AS level, (sum(high_value) + 0.5::DOUBLE) / (count(*) - sum(high_value) + 0.5::DOUBLE) AS o
  FROM labelled WHERE dataset = 'Train' GROUP BY 1),
half_base AS (SELECT min(level) AS first, arg_min(o, level) AS o0 FROM half)""",
    )
    q["residual_normal_points"] = on(
        "filled",
        f"""
SELECT rank, round({_normal_quantile('p')}, 6) AS expected, round(e, 6) AS observed
FROM (SELECT rank, e, (rank - 0.5::DOUBLE) / n AS p FROM (SELECT e, n, row_number() OVER (ORDER BY e) AS rank
    FROM (SELECT basket_value - pred AS e, count(*) OVER () AS n FROM scored WHERE dataset = 'Train'
      AND basket_value - pred IS NOT NULL))
  WHERE rank IN (SELECT (2 * j + 1) * (SELECT count(*) FROM scored WHERE dataset = 'Train'
    AND basket_value - pred IS NOT NULL) // 200 + 1 FROM range(100) AS g(j)))""",
        _SCORED,
    )
    q["auc_interval"] = on(
        "filled",
        """
SELECT CAST(p AS BIGINT) AS n_positive, CAST(n AS BIGINT) AS n_negative, round(auc, 6) AS auc, round(se, 6) AS std_error,
  round(auc - 1.959963984540054 * se, 6) AS low, round(auc + 1.959963984540054 * se, 6) AS high
FROM (SELECT count(*) FILTER (high_value = 1) AS p, count(*) FILTER (high_value = 0) AS n,
    avg(below) FILTER (high_value = 1) AS auc,
    sqrt(var_samp(below) FILTER (high_value = 1) / count(*) FILTER (high_value = 1)
      + var_samp(above) FILTER (high_value = 0) / count(*) FILTER (high_value = 0)) AS se
  FROM (SELECT high_value,
      (coalesce(sum(1 - high_value) OVER lower, 0) + sum(1 - high_value) OVER same * 0.5::DOUBLE) / sum(1 - high_value) OVER () AS below,
      (sum(high_value) OVER () - coalesce(sum(high_value) OVER lower, 0) - sum(high_value) OVER same * 0.5::DOUBLE) / sum(high_value) OVER () AS above
    FROM labelled WHERE dataset = 'Test' AND pred IS NOT NULL
    WINDOW same AS (PARTITION BY pred),
      lower AS (ORDER BY pred RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)))""",
        _SCORED,
    )
    # The greatest over all starts of the least mean over all ends: the isotonic fit without pooling.
    q["calibrated_ranking"] = on(
        "filled",
        """
SELECT booking_id, round(value, 6) AS probability, high_value FROM labelled
ASOF LEFT JOIN (SELECT k, max(low) AS value FROM (
    SELECT i.x AS i, k.x AS k, min((j.total - i.total + i.y) / (j.n - i.n + i.m)) AS low
    FROM run i JOIN run k ON i.x <= k.x JOIN run j ON j.x >= k.x GROUP BY 1, 2) GROUP BY k) fit
  ON greatest(floor(pred / 1000), (SELECT min(x) FROM run)) >= k
WHERE dataset = 'Test'""",
        _SCORED
        + """,
run AS (SELECT x, m, y, sum(m) OVER (ORDER BY x) AS n, sum(y) OVER (ORDER BY x) AS total
  FROM (SELECT floor(pred / 1000) AS x, count(*)::DOUBLE AS m, sum(high_value)::DOUBLE AS y FROM labelled
    WHERE dataset = 'Train' AND pred IS NOT NULL GROUP BY 1))""",
    )
    q["row_number"] = on(
        "basket",
        "SELECT booking_id, row_number() OVER (ORDER BY ord_a NULLS LAST, ord_b NULLS LAST, ord_c NULLS LAST, "
        "basket_value NULLS LAST, booking_id NULLS LAST) AS row_number FROM basket",
    )
    texts = [
        "booking_id", "booking_datetime", "customer_segment", "service_type", "city", "payment_method",
        "booking_channel", "promo_code_used", "discount_amount", "traffic_level", "weather_condition",
        "cancellation_reason",
    ]
    kinds = ("boolean", "integer", "number", "date", "timestamp")
    guess = " ".join(f"WHEN n > 0 AND \"{t}\" >= 0.9 * n THEN '{t}'" for t in kinds)
    fit = " ".join(f"WHEN n > 0 AND \"{t}\" >= 0.9 * n THEN \"{t}\"" for t in kinds)
    q["guess_types"] = on(
        "bookings",
        f"SELECT variable, CASE {guess} ELSE 'text' END AS guess, n, CASE {fit} ELSE n END AS n_fit, "
        f"n - CASE {fit} ELSE n END AS n_rejected FROM ({' UNION ALL '.join(map(_type_counts, texts))})",
    )
    q["rejected_cells"] = on(
        "bookings",
        "SELECT booking_id, 'discount_amount' AS variable, discount_amount AS cell, 'number' AS wanted FROM bookings "
        "WHERE trim(discount_amount) <> '' AND TRY_CAST(discount_amount AS DOUBLE) IS NULL UNION ALL "
        "SELECT booking_id, 'booking_datetime', booking_datetime, 'timestamp' FROM bookings "
        "WHERE trim(booking_datetime) <> '' AND TRY_CAST(booking_datetime AS TIMESTAMP) IS NULL UNION ALL "
        "SELECT booking_id, 'payment_method', payment_method, 'boolean' FROM bookings "
        "WHERE trim(payment_method) <> '' AND lower(trim(payment_method)) NOT IN ('true', 'false', 'yes', 'no')",
    )
    q["logit_scores_one"] = on(
        "filled",
        "SELECT booking_id, round(p, 5) AS probability, high_value FROM labelled LEFT JOIN odds "
        "ON service_type = level WHERE dataset = 'Test'",
        _SCORED + "," + odds,
    )
    q["same_columns"] = on(
        "filled",
        "SELECT dataset, count(*) AS n_rows, 17 AS n_columns, true AS same FROM filled GROUP BY 1",
    )
    q["final_train_levels"] = on(
        "filled",
        "SELECT booking_id, dataset, CASE WHEN promo_code_used IN (SELECT promo_code_used FROM filled "
        "WHERE dataset = 'Train') THEN promo_code_used END AS promo_code_used FROM filled",
    )
    return q
