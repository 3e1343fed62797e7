"""Benchmark decontamination by word windows.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window; an item of fewer words is one window of its own length.
WINDOW = 10
#: What parts words: ASCII other than digits and lower-case letters (of lower-cased text).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on text whose A-Z are as they were.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Where all characters are ASCII that is ``lower``, which is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    found = F.array_remove(F.split(ascii_lower(text), GAP), "")
    return F.coalesce(found, F.expr("cast(array() as array<string>)"))


def _window_hash(words: str, at: str, size: int) -> Column:
    """64-bit hash of the ``size`` words from place ``at``, as codegen'd code over single words."""
    taken = [F.expr(f"get({words}, {at} + {i})") for i in range(size)]
    return F.xxhash64(F.lit(size), *taken)


def _joined(words: str, at: str, size: str) -> Column:
    return F.expr(f"array_join(slice({words}, {at} + 1, {size}), ' ')")


def windows_of(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``hash``, ``size``, ``words`` and ``items`` (ids as sorted text) of each distinct window.

    A window that several items have is one row.  Items without words have none; the windows
    of an item whose id is null count, but the item has no name to be listed by.
    """
    cut = items.select(
        F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    sized = cut.withColumn("size", F.least(F.size("words"), F.lit(window)))
    placed = sized.withColumn("at", F.explode(F.expr("sequence(0, size(words) - size)")))
    return (
        placed.select("size", _joined("words", "at", "size").alias("words"), "item")
        .groupBy("size", "words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("hash", F.xxhash64("size", F.split("words", " ")))
    )


def _is_small(windows: DataFrame, most_bytes: int) -> bool:
    """Whether the windows and their items take at most ``most_bytes`` as a broadcast hash set."""
    size = windows.agg(
        F.sum(F.octet_length("words") + 64 + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16))
    ).first()[0]
    return (size or 0) <= most_bytes


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: ``id``, ``digest`` (of the text), ``n_words``, ``n_hit`` (words inside
    an occurrence of an item's window), ``items`` (sorted ids of items with occurring windows)
    and ``spans`` (structs ``start``, ``end`` of hit words, in order, not touching).

    The hash set of item windows is broadcast after its size was measured; beyond
    ``broadcast_bytes`` the same join shuffles.  Windows of a document meet it inside generated
    code, as 64-bit hashes; a hit is verified by its words before it counts.  Only hits and one
    row per document are shuffled, so the texts are scanned once and stay where they are.
    Windows are kept by length: an item of fewer than ``window`` words is one short window.

    A null or wordless text has zero counts.  Rows that repeat an id with another text are rows
    of their own; equal rows each get their row.  No items, or none with words: no hits.  An
    empty table gives an empty result.  Other columns are not read.
    """
    windows = windows_of(items, item_id_col, item_text_col, window)
    # At most ``window`` numbers.
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    held = windows.select("hash", F.col("words").alias("window"), "items")
    held = F.broadcast(held) if _is_small(windows, broadcast_bytes) else held
    cut = docs.select(
        F.col(id_col).alias("id"),
        F.md5(F.col(text_col).cast("binary")).alias("digest"),
        words_of(F.col(text_col)).alias("words"),
    )
    # Place -1 stands for the document itself; its key is its own, so no key is frequent.
    last = F.greatest(F.lit(-1), F.size("words") - min(sizes, default=0)) if sizes else F.lit(-1)
    placed = cut.select("id", "digest", "words", F.explode(F.sequence(F.lit(-1), last)).alias("at"))
    own = F.xxhash64(F.lit("document"), "id", "digest")
    names = [F.struct(F.lit(s).alias("size"), _window_hash("words", "at", s).alias("hash")) for s in sizes]
    if len(sizes) == 1:
        probed = placed.select("*", F.lit(sizes[0]).alias("size"), _window_hash("words", "at", sizes[0]).alias("probe"))
    elif sizes:
        probed = placed.select("*", F.inline(F.array(*names)).alias("size", "probe")).where(
            F.when(F.col("at") < 0, F.col("size") == sizes[0]).otherwise(F.col("at") + F.col("size") <= F.size("words"))
        )
    else:
        probed = placed.select("*", F.lit(0).alias("size"), F.lit(None).cast("long").alias("probe"))
    probed = probed.withColumn("probe", F.when(F.col("at") < 0, own).otherwise(F.col("probe")))
    # The words are compared after the join: in its condition they would be a key, so text for each place.
    met = probed.join(held, F.col("probe") == F.col("hash"), "left").where("at < 0 or window is not null")
    verified = F.when(F.col("at") < 0, True).otherwise(_joined("words", "at", "size") == F.col("window"))
    hits = met.where(verified)
    hit = F.when(F.col("at") >= 0, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))
    found = (
        hits.select(
            "id",
            "digest",
            F.when(F.col("at") < 0, F.size("words")).alias("n"),
            hit.alias("hit"),
            F.when(F.col("at") >= 0, F.col("items")).alias("items"),
        )
        .groupBy("id", "digest")
        .agg(
            F.count("n").alias("copies"),
            F.max("n").cast("long").alias("n_words"),
            F.sort_array(F.collect_set("hit")).alias("hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    spans = F.aggregate("hits", F.expr("cast(array() as array<struct<start: int, end: int>>)"), _merge)
    told = found.withColumn("spans", F.when(F.size("hits") > 0, spans).otherwise(F.col("hits")))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    one_each = F.explode(F.expr("sequence(1L, copies)"))
    return told.select(
        "id", "digest", "n_words", total.alias("n_hit"), "items", "spans", one_each.alias("copy")
    ).drop("copy")


def _merge(spans: Column, span: Column) -> Column:
    """Adds a span to sorted ones; one that begins inside or at the end of the last prolongs it."""
    last = F.element_at(spans, -1)
    longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
    front = F.slice(spans, F.lit(1), F.size(spans) - 1)
    joins = (F.size(spans) > 0) & (span["start"] <= F.try_element_at(spans, F.lit(-1))["end"])
    return F.when(joins, F.concat(front, F.array(longer))).otherwise(F.concat(spans, F.array(span)))


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of
    every document, from :func:`contamination`."""
    return contamination(docs, items, **how).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and what follows each of them up to the next word."""
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    piece = ANY_CASE_WORD + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    starts = F.transform(spans, lambda s: s["start"])
    # Pieces between spans: from each end to the next start.
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(starts, F.array(F.size(pieces)))
    kept = F.transform(
        F.arrays_zip(ends.alias("a"), stops.alias("b")),
        lambda p: F.array_join(F.slice(pieces, p["a"] + 1, p["b"] - p["a"]), ""),
    )
    return F.concat(head, F.array_join(kept, ""))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    remove: str = "spans",
    most_share: float = 1.0,
    **how,
) -> DataFrame:
    """The documents without benchmark passages; all columns as they were, the text cut.

    ``remove="spans"`` cuts hit words out of the texts, ``remove="documents"`` drops documents
    with a hit.  With spans, a document of whose words more than ``most_share`` are hit is
    dropped as well.  Clean documents and null texts stay as they are.  Only rows with hits are
    joined, by id and text digest; a small table of them is broadcast by Spark itself.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    hit = (
        contamination(docs, items, id_col, text_col, **how)
        .where("n_hit > 0")
        .select("id", "digest", "n_words", "n_hit", "spans")
        .dropDuplicates(["id", "digest"])
    )
    # One struct holds the caller's columns, so none of their names can clash.
    packed = docs.select(F.struct("*").alias("row"))
    row = lambda c: F.col("row")[c]
    same = row(id_col).eqNullSafe(F.col("id")) & (F.md5(row(text_col).cast("binary")) == F.col("digest"))
    if remove == "documents":
        return packed.join(hit, same, "left_anti").select("row.*")
    joined = packed.join(hit, same, "left").where(
        F.col("n_hit").isNull() | (F.col("n_hit") <= F.col("n_words") * F.lit(most_share))
    )
    text = F.when(F.col("spans").isNull(), row(text_col)).otherwise(_without(row(text_col), F.col("spans")))
    return joined.select(*[(text if c == text_col else row(c)).alias(c) for c in docs.columns])


def oracle() -> str:
    """The report as DuckDB SQL: windows of both tables as text, joined."""
    alphabet = f"translate(text, '{UPPER}', '{LOWER}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all({alphabet}, '{word}'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({alphabet}, '{word}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM (SELECT item, w, least(len(w), {WINDOW}) AS size FROM b WHERE len(w) > 0))),
dw AS (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
hit AS (SELECT DISTINCT k, i, size, item FROM dw JOIN bw USING (size, s)),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + size)) AS p FROM hit) GROUP BY k),
named AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k)"""
