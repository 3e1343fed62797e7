"""Near-duplicate documents by SimHash fingerprints, with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_runs, components, spanning_labels, staged, tasks, text_buffer

#: Widths of the five segments of the ring, from the lowest bit up.
SEGMENTS = (13, 13, 13, 13, 12)
#: Differing bits at which fingerprints still link.
BUDGET = 3
#: Hash seed of a shingle.
SEED = 42


def _masks() -> list[int]:
    out, at = [], 0
    for width in SEGMENTS:
        out.append(((1 << width) - 1) << at)
        at += width
    return out


MASKS = _masks()


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit number.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, as the definition asks.  A bit is
    set where over half of the shingle hashes have it.  No word: 0.  Fewer words than a
    shingle: the hash of them all.
    """
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())],
        np.uint64,
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) of every row, over its whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            whole, at = data.tobytes(), at.tolist()
            fps = np.array(
                [fingerprint(whole[a:b], shingle) for a, b in zip(at, at[1:])], np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(
        run, "id long, fp long"
    )


def chain_keys(fp: str = "fp"):
    """The ten join keys of a fingerprint, as an array of structs (``start``, ``key``).

    Pigeonring: if at most 3 of 64 bits differ over a ring of 5 segments, some segment starts
    a chain whose first 1, 2, 3, 4 segments differ in at most 0, 1, 1, 2 bits (l * 3 / 5,
    rounded down).  The first three budgets say: the first segment is equal, and so is the
    second or the third.  Each start hence has two keys of about 26 equal bits; the longer
    prefixes of the chain are checked on the pairs that the keys bring together.
    """
    entries = []
    for i in range(len(SEGMENTS)):
        for step in (1, 2):
            mask = MASKS[i] | MASKS[(i + step) % len(SEGMENTS)]
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            entries.append(
                f"struct({i} as start, xxhash64({fp} & {signed}L, {i * 2 + step}) as key)"
                if signed != -(1 << 63)
                else f"struct({i} as start, xxhash64({fp}, {i * 2 + step}) as key)"
            )
    return F.expr(f"array({', '.join(entries)})")


def linked_pairs(fps: np.ndarray, starts: np.ndarray, runs: np.ndarray, most: int = 1 << 21):
    """Row numbers of linked pairs within runs of an equal key, a slice at a time.

    A pair first has to keep the chain's budget over four segments, then over all 64 bits.
    """
    chain = np.array(
        [
            sum(MASKS[(i + j) % len(SEGMENTS)] for j in range(4))
            for i in range(len(SEGMENTS))
        ],
        np.uint64,
    )
    change = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    left = np.repeat(np.r_[change[1:], len(runs)], np.diff(np.r_[change, len(runs)])) - np.arange(len(runs))
    rows = np.arange(len(runs))
    step = 1
    while len(rows := rows[left[rows] > step]):
        for at in range(0, len(rows), most):
            a = rows[at : at + most]
            x = fps[a] ^ fps[a + step]
            a, x = (v[np.bitwise_count(x & chain[starts[a]]) <= 2] for v in (a, x))
            a = a[np.bitwise_count(x) <= BUDGET]
            if len(a):
                yield a, a + step
        step += 1


def links(distinct: DataFrame, tile: int = 4096) -> DataFrame:
    """Edges ``a``, ``b`` between ids that connect all fingerprints at most 3 bits apart.

    ``distinct`` has one row per fingerprint: ``fp`` and the least ``id`` that has it.  Rows
    that share a key meet in one run.  A key with more rows than ``tile`` is cut into chunks,
    and each pair of chunks is a run of its own, so no run is longer than two chunks.  A run
    gives at most one edge per row (a forest of its links), never all its pairs.
    """
    spark = distinct.sparkSession
    keyed = distinct.select("id", "fp", F.inline(chain_keys())).select("id", "fp", "start", "key")
    hot = keyed.groupBy("key").count().where(F.col("count") > tile)
    cut = keyed.join(
        hot.select("key", F.ceil(F.col("count") / tile).cast("int").alias("k")), "key", "left"
    ).withColumn("c", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("k"))))
    tiles = cut.withColumn(
        "j", F.explode(F.expr("if(k is null, array(0L), sequence(0L, cast(k - 1 as bigint)))"))
    ).select(
        "id",
        "fp",
        "start",
        F.expr("if(k is null, key, xxhash64(key, least(c, j), greatest(c, j)))").alias("run"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in complete_runs(batches, "run"):
            ids = piece["id"].to_numpy()
            fps = piece["fp"].to_numpy().view(np.uint64)
            labels = np.arange(len(ids))
            for a, b in linked_pairs(fps, piece["start"].to_numpy(), piece["run"].to_numpy()):
                labels = spanning_labels(len(ids), a, b, labels)
            hung = np.flatnonzero(labels != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[hung]), pa.array(ids[labels[hung]])], names=["a", "b"]
            )

    return (
        tiles.repartition(tasks(spark), "run")
        .sortWithinPartitions("run")
        .mapInArrow(run, "a long, b long")
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    tile: int = 4096,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents link when their fingerprints differ in at most 3 bits; the component is the
    smallest id reachable over links.  Null and wordless texts have the fingerprint zero and
    link like any other.  Rows that repeat an id stay rows of their own.  A null id gets its
    fingerprint; its component is that of its fingerprint, or null if only null ids have it
    and nothing else links.  An empty table gives an empty result.

    Copies share a fingerprint and are folded before candidates are sought, so a group of
    copies costs one row; the fold is a combining aggregate.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle))
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("id")))
    linked = components(links(distinct.where("id is not null"), tile))
    classes = distinct.join(linked, distinct["id"] == linked["node"], "left").select(
        F.col("fp"), F.coalesce("component", "id").alias("component_id")
    )
    return prints.join(classes, "fp").select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """The documents with the smallest id of their component; all columns as they were.

    Rows that share that smallest id all stay; so do rows whose component is null.
    """
    groups = simhash_groups(docs, id_col, text_col, **how)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    # One struct holds the caller's columns, so none of their names can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(gone, F.col("row")[id_col].cast("long") == F.col("doc_id"), "left_anti").select("row.*")
