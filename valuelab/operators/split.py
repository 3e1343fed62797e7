"""Reproducible train / test split, stratified on a numeric target.

Fitting finds a handful of numbers: the bin edges of the target and, per bin, the
hash and key of the last training row.  Applying them is a projection, so every
row's side depends only on its key, its target and those numbers; repartitioning
or re-running changes nothing, and no sort of the table takes place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import number
from .quantiles import quantile_summary

TRAIN = "Train"
TEST = "Test"
_STEP = 4  # hex digits per refinement: 65,536 buckets per bin
_DIGITS = 32


def _key_text(key: str) -> Column:
    """The key as text; a null key is one key value."""
    return F.coalesce(F.col(key).cast("string"), F.lit("(null)"))


def _row_hash(key: str, seed: int | str) -> Column:
    return F.md5(F.concat(_key_text(key), F.lit(f":{seed}")))


def with_row_hash(df: DataFrame, key: str, seed: int | str, name: str) -> DataFrame:
    """``df`` with the hash that the split orders rows by, for tables that are written before they are split."""
    return df.withColumn(name, _row_hash(key, seed))


def _bin(target: str, edges: Sequence[float]) -> Column:
    """Bin from 1; bins are closed on the right, the lowest also on the left."""
    y = number(target)
    above = [(y > F.lit(e)).cast("int") for e in edges]
    return F.when(y.isNotNull(), reduce(lambda a, b: a + b, above, F.lit(1)))


@dataclass(frozen=True)
class SplitRule:
    key: str
    target: str
    seed: int | str
    edges: tuple[float, ...]
    #: bin -> (hash, key) of the last training row
    cutoffs: dict[int, tuple[str, str]]
    #: bin -> (rows, training rows)
    sizes: dict[int, tuple[int, int]]
    n_without_target: int

    def bin(self) -> Column:
        return _bin(self.target, self.edges)

    def side(self, hash_col: str | None = None) -> Column:
        """Train / Test; null where the target is missing.  ``hash_col`` is that of :func:`with_row_hash`."""
        bin_ = self.bin()
        # Hashes have one length, so hash and key compare as one text, which finds the hash once.
        own = _row_hash(self.key, self.seed) if hash_col is None else F.col(hash_col)
        place = F.concat(own, _key_text(self.key))
        ends = [self.cutoffs.get(b) for b in range(1, len(self.edges) + 2)]
        last = F.array(*[F.lit(None if e is None else "".join(e)).cast("string") for e in ends])
        train = F.coalesce(place <= F.get(last, bin_ - 1), F.lit(False))
        return F.when(bin_.isNotNull(), F.when(train, F.lit(TRAIN)).otherwise(F.lit(TEST)))

    def apply(self, df: DataFrame, name: str = "dataset", hash_col: str | None = None) -> DataFrame:
        """``df`` with the side of every row; rows without a target stay, their side is null."""
        sided = df.withColumn(name, self.side(hash_col))
        return sided if hash_col is None else sided.drop(hash_col)


def fit_split(
    df: DataFrame,
    key: str,
    target: str,
    train_share: float = 0.8,
    seed: int | str = 123,
    bins: int = 4,
    max_window_rows: int = 200_000,
    hash_col: str | None = None,
) -> SplitRule:
    """Fit the split: ceil(share * n) training rows in each bin.

    ``key`` must be unique (run ``dedupe_first`` before).  The cut in each bin is
    found on counts per hash prefix, at most 65,536 per bin; the prefix that holds
    it is refined until its rows are few, and only those are ranked.  ``hash_col`` names a
    column from :func:`with_row_hash` (same key and seed); without it each pass hashes the keys.
    """
    probs = [i / bins for i in range(1, bins)]
    y = number(target)
    found = quantile_summary(
        df,
        [target],
        probs,
        extra=[("__low", F.min(y)), ("__null", F.count(F.lit(1)) - F.count(y))],
        name=lambda _, p: f"__e{probs.index(p)}",
    ).first()
    raw = [found[f"__e{i}"] for i in range(len(probs))]
    # Tied edges merge their bins, as does an edge on the minimum.
    edges = tuple(sorted({e for e in raw if e is not None and e > found["__low"]}))

    hashed = df.select(
        _bin(target, edges).alias("b"),
        (_row_hash(key, seed) if hash_col is None else F.col(hash_col)).alias("h"),
        _key_text(key).alias("k"),
    ).where(F.col("b").isNotNull())

    digits, open_bins = _STEP, None
    sizes: dict[int, tuple[int, int]] = {}
    while True:
        counts = _prefix_counts(hashed, digits, open_bins)
        rows = _cut_prefixes(counts, train_share, open_bins)
        if open_bins is None:
            sizes = {r["b"]: (r["n"], r["need"]) for r in rows}
        open_bins = {r["b"]: (r["p"], r["need"] - r["before"], r["f"]) for r in rows}
        if digits >= _DIGITS or all(f <= max_window_rows for _, _, f in open_bins.values()):
            break
        digits += _STEP
    return SplitRule(
        key,
        target,
        seed,
        edges,
        _last_training_rows(hashed, open_bins),
        sizes,
        found["__null"],
    )


def _in_open_prefix(open_bins: dict) -> Column:
    """Whether a row's hash starts with its bin's open prefix: one comparison, which finds the hash once."""
    if not open_bins:
        return F.lit(False)
    prefixes = [open_bins[b][0] if b in open_bins else None for b in range(1, max(open_bins) + 1)]
    wanted = F.get(F.array(*[F.lit(p).cast("string") for p in prefixes]), F.col("b") - 1)
    return F.coalesce(F.col("h").startswith(wanted), F.lit(False))


def _prefix_counts(hashed: DataFrame, digits: int, open_bins: dict | None) -> DataFrame:
    rows = hashed if open_bins is None else hashed.where(_in_open_prefix(open_bins))
    return rows.groupBy("b", F.substring("h", 1, digits).alias("p")).agg(
        F.count(F.lit(1)).alias("f")
    )


def _cut_prefixes(counts: DataFrame, share: float, open_bins: dict | None) -> list:
    """The prefix of each bin in which the last training row lies: one row per bin."""
    whole = W.partitionBy("b")
    running = whole.orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    if open_bins is None:
        need = F.ceil(F.col("n") * F.lit(float(share)))
    else:
        need = reduce(
            lambda a, item: F.when(F.col("b") == item[0], F.lit(item[1][1])).otherwise(a),
            open_bins.items(),
            F.lit(None).cast("bigint"),
        )
    placed = (
        counts.withColumns({"upto": F.sum("f").over(running), "n": F.sum("f").over(whole)})
        .withColumns({"need": need.cast("bigint"), "before": F.col("upto") - F.col("f")})
        .where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("upto")))
    )
    return placed.select("b", "p", "f", "n", "need", "before").collect()


def _last_training_rows(hashed: DataFrame, open_bins: dict) -> dict[int, tuple[str, str]]:
    if not open_bins:
        return {}
    ranked = hashed.where(_in_open_prefix(open_bins)).withColumn(
        "rank", F.row_number().over(W.partitionBy("b").orderBy("h", "k"))
    )
    last = reduce(
        lambda a, b: a | b,
        [
            (F.col("b") == b) & (F.col("rank") == need) for b, (_, need, _) in open_bins.items()
        ],
    )
    return {r["b"]: (r["h"], r["k"]) for r in ranked.where(last).collect()}


def split_sizes(df: DataFrame, side: str = "dataset") -> DataFrame:
    """``side``, ``n``, ``percentage``: a window over the group table only."""
    counts = df.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", F.col("n") / F.sum("n").over(W.partitionBy()) * 100)


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Same names, types and order."""
    return [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]


def expected_train_rows(bin_sizes: Sequence[int], share: float = 0.8) -> int:
    return sum(math.ceil(n * share) for n in bin_sizes)
