"""Quality rules: a threshold table compiled into one projection.  No user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as the characters themselves.
SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was de la le les et des en un une que qui dans der die das und "
    "von mit ist nicht ein eine zu den el los las y del por con una es a"
).split()

#: What can be measured in a text, from the columns of ``counted``.
MEASURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_ratio": "n_symbols / n_words",
    "duplicate_line_ratio": "n_dup_lines / n_lines",
    "stop_word_ratio": "n_stop_words / n_words",
    "repeat_ratio": "n_repeat_words / n_words",
}

#: The threshold table: a document is kept if every measure lies in its range (None: open).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("words", 50, 200_000),
    ("word_length", 2.0, 15.0),
    ("symbol_ratio", None, 0.3),
    ("duplicate_line_ratio", None, 0.4),
    ("stop_word_ratio", 0.02, None),
    ("repeat_ratio", None, 0.5),
)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_repeat_words``: words in 3-word windows that occur twice or more.

    Windows are sorted by two hashes and their place, so equal ones are neighbours: n log n in
    the number of words, whatever repeats.  Each step is a column of its own, since a lambda
    would compute what is no column again for each element.
    """
    window = lambda i: [F.get("words", i + k) for k in range(3)]
    windows = F.transform(
        F.expr("if(n_words < 3, cast(array() as array<int>), sequence(0, cast(n_words as int) - 3))"),
        lambda i: F.struct(
            F.xxhash64(*window(i)).alias("h"), F.hash(*window(i)).alias("g"), i.alias("i")
        ),
    )
    rows = rows.withColumn("_windows", F.sort_array(windows))

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

    repeated = F.transform(
        "_windows",
        lambda x, i: F.when(
            alike(x, F.get("_windows", i - 1)) | alike(x, F.get("_windows", i + 1)), x["i"]
        ),
    )
    rows = rows.withColumn("_places", F.sort_array(F.filter(repeated, lambda p: p.isNotNull())))
    # each place adds the words that the place before it does not cover
    gaps = F.transform(
        "_places",
        lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_places", i - 1))),
    )
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.withColumn("n_repeat_words", total).drop("_windows", "_places")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules use, as longs.  A null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", WORD_BREAK), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACE, "") != "").alias("lines"),
    )
    return _with_repeats(base.withColumn("n_words", F.size("words").cast("long"))).select(
        "doc_id",
        "n_words",
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one condition; a measure over nothing (0 words) fails no rule."""
    out = F.lit(True)
    for measure, least, most in rules:
        value = F.expr(_safe(MEASURES[measure]))
        if least is not None:
            out = out & F.coalesce(value >= least, F.lit(True))
        if most is not None:
            out = out & F.coalesce(value <= most, F.lit(True))
    return out


def _safe(measure: str) -> str:
    top, _, bottom = measure.partition(" / ")
    return f"{top} / nullif({bottom}, 0)" if bottom else top


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: not base-failed and inside every range of the threshold table.  One projection
    over the scan, without a shuffle.  Rows that repeat an id are judged alone; an empty
    table gives an empty result.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted(docs, id_col, text_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def oracle() -> str:
    """The same projection as DuckDB SQL."""
    conditions = []
    for measure, least, most in RULES:
        value = _safe(MEASURES[measure])
        if least is not None:
            conditions.append(f"coalesce({value} >= {least}, true)")
        if most is not None:
            conditions.append(f"coalesce({value} <= {most}, true)")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: translate(l, {space}, '') <> '') AS lines
  FROM documents
), grams AS (
  SELECT doc_id, unnest(range(0, greatest(len(words) - 2, 0))) AS i,
    unnest([words[j + 1] || ' ' || words[j + 2] || ' ' || words[j + 3]
      for j in range(0, greatest(len(words) - 2, 0))]) AS g FROM base
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id
), counts AS (
  SELECT base.doc_id, len(words) AS n_words, length(translate(text, {space}, '')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({stops}))) AS n_stop_words
  FROM base LEFT JOIN covered USING (doc_id)
)
SELECT *, base_ok IS FALSE AS base_failed, base_ok AND {" AND ".join(conditions)} AS kept FROM (
  SELECT *, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_ok FROM counts)
""".replace("SELECT *, base_ok IS FALSE", "SELECT * EXCLUDE (base_ok), base_ok IS FALSE")
