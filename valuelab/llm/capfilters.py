"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_runs, components, spanning_labels, staged, tasks


@dataclass(frozen=True)
class Code:
    """``codes`` product codes of ``blocks`` codebooks with ``words`` random directions each.

    A filter is one word from each codebook of a code, so a code has ``words ** blocks``
    directions and a vector's products with all of them follow from ``blocks * words``
    products.  ``mean_filters`` is how many directions of a code a random vector exceeds.
    """

    codes: int = 6
    blocks: int = 2
    words: int = 512
    mean_filters: float = 10.0
    seed: int = 5
    #: Up to this length one book of single directions is used, and this cosine is its threshold.
    short: int = 12
    short_least: float = 0.766
    #: Directions that two short vectors at the cosine looked for exceed both, on average.
    short_common: float = 14.0


def short_book(dim: int, code: Code, least: float) -> np.ndarray:
    """Directions for short vectors, so many that neighbours exceed ``short_common`` of them.

    In few dimensions the product code's quantile is wide of the mark; a cap of a fixed width
    is not.  How many directions it takes follows from the share of random ones that a pair at
    cosine ``least`` exceeds both.
    """
    random = np.random.default_rng([code.seed, dim])
    draws = random.normal(size=(200_000, dim))
    draws /= np.linalg.norm(draws, axis=1, keepdims=True)
    first = draws[:, 0] >= code.short_least
    if dim == 1:
        return np.array([[1.0], [-1.0]])
    second = draws[:, 0] * least + draws[:, 1] * np.sqrt(max(0.0, 1 - least * least)) >= code.short_least
    share = max(float((first & second).mean()), 1e-4)
    return draws[: min(len(draws), int(np.ceil(code.short_common / share)))]


def codebooks(dim: int, code: Code, least: float = 0.98) -> list[tuple[np.ndarray, list[np.ndarray], float]]:
    """For each code its rotation, its codebooks and the least product that counts.

    Vectors of at most ``code.short`` components have one code of one book, :func:`short_book`.

    The threshold is the quantile of the products of 2,000 random unit vectors at which
    ``mean_filters`` directions are exceeded on average.
    """
    if dim <= code.short:
        return [(np.eye(dim), [short_book(dim, code, least)], code.short_least)]
    cuts = [round(dim * b / code.blocks) for b in range(code.blocks + 1)]
    out = []
    for number in range(code.codes):
        random = np.random.default_rng([code.seed, number, dim])
        rotation = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        books = []
        for low, high in zip(cuts, cuts[1:]):
            book = random.normal(size=(code.words, max(1, high - low)))[:, : high - low]
            norm = np.linalg.norm(book, axis=1, keepdims=True)
            books.append(book / np.where(norm > 0, norm, 1) / np.sqrt(code.blocks))
        probe = random.normal(size=(2000, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        parts = [probe[:, a:b] @ book.T for a, b, book in zip(cuts, cuts[1:], books)]
        # Products with a random word of each book; the tail comes from many such draws.
        draws = sum(part[:, random.integers(0, code.words, 2000)] for part in parts)
        share = min(0.5, code.mean_filters / float(code.words) ** code.blocks)
        out.append((rotation, books, float(np.quantile(draws, 1 - share))))
    return out


def list_decode(vectors: np.ndarray, books: list[np.ndarray], least: float):
    """Row and filter number of every direction whose product with a row is ``least`` or more.

    Depth first over the codebooks: a prefix of words is dropped as soon as the best words of
    the remaining books cannot lift it over the threshold.
    """
    cuts = np.cumsum([0, *[b.shape[1] for b in books]])
    parts = [vectors[:, a:b] @ book.T for a, b, book in zip(cuts, cuts[1:], books)]
    best_after = [sum((p.max(axis=1) for p in parts[i + 1 :]), np.zeros(len(vectors))) for i in range(len(parts))]
    row, word = np.nonzero(parts[0] + best_after[0][:, None] >= least)
    total, number = parts[0][row, word], word.astype(np.int64)
    for i in range(1, len(parts)):
        rows, words, sums, numbers = [], [], [], []
        for low in range(0, len(row), 20_000):
            r = row[low : low + 20_000]
            s = total[low : low + 20_000, None] + parts[i][r]
            at, w = np.nonzero(s + best_after[i][r][:, None] >= least)
            rows.append(r[at])
            sums.append(s[at, w])
            numbers.append(number[low : low + 20_000][at] * len(books[i]) + w)
        row, total, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, sums, numbers))
    return row, number


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, vector_col: str, label_col: str):
    """Whether a row can link at all: label and vector given, all components finite, one not zero."""
    v = F.col(vector_col)
    good = F.forall(
        v,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    return F.coalesce(
        F.col(label_col).isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def _assign(code: Code, least: float):
    """(rep, filter) of every direction that a vector exceeds; rows come in order of length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, tables = -1, []
        size = code.words**code.blocks
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                for batch in _by_length(whole.slice(low, 2000), 1):
                    rows = _matrix(batch.column(1))
                    if rows.shape[1] != dim:
                        dim = rows.shape[1]
                        tables = codebooks(dim, code, least)
                    rows /= np.abs(rows).max(axis=1, keepdims=True)
                    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                    ids = batch.column(0).to_numpy()
                    step = max(1, (1 << 22) // max(len(b) for _, books, _ in tables for b in books))
                    for start in range(0, len(ids), step):
                        some = rows[start : start + step]
                        found = [list_decode(some @ q, books, top) for q, books, top in tables]
                        at = np.concatenate([r for r, _ in found])
                        number = np.concatenate([f + i * size for i, (_, f) in enumerate(found)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[start + at]), pa.array(number)], names=["rep", "filter"]
                        )

    return run


def _by_length(rows, column: int):
    """The rows of a batch or table, those of one list length at a time."""
    values = rows.column(column)
    sizes = np.diff((values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).offsets.to_numpy())
    found = np.unique(sizes)
    if len(found) == 1:
        yield rows
        return
    for size in found.tolist():
        part = rows.take(pa.array(np.flatnonzero(sizes == size)))
        yield part.combine_chunks() if isinstance(part, pa.Table) else part


def _padded(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, short rows filled with -1."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.full((len(sizes), int(sizes.max()) if len(sizes) else 0), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


#: Runs of so many vectors are compared by matrix products, smaller ones many at a time.
DENSE = 12


def _dense(rows: np.ndarray, filters: np.ndarray, own: int, side: np.ndarray, least: float):
    """Links of one run as a matrix (above the diagonal), and those that count here (both ways):
    the pair has no earlier filter in common, and lies across the chunks of a pair of chunks."""
    near = rows @ rows.T >= least
    np.fill_diagonal(near, False)
    earlier = (filters >= 0) & (filters < own)
    row = np.nonzero(earlier)[0]
    known, place = np.unique(filters[earlier], return_inverse=True)
    has = np.zeros((len(rows), len(known)), np.float32)
    has[row, place] = 1
    new = near & (has @ has.T < 0.5)
    new &= (side[:, None] < 0) | (side[:, None] != side[None, :])
    return np.triu(near), new


def _verify(least: float):
    """Links within runs of one filter: verified by cosine, counted at their first common filter.

    Gives (node, other, links): ``links`` of ``node`` to count, and an edge of the run's
    spanning forest if ``other`` differs from it.  Never a row per pair.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = complete_runs(batches, "run", 20_000)
        for piece in (part for table in whole for part in _by_length(table, table.column_names.index("vector"))):
            ids, n = piece["rep"].to_numpy(), piece["n"].to_numpy()
            runs, own = piece["run"].to_numpy(), piece["filter"].to_numpy()
            side = piece["side"].to_numpy()
            rows = _matrix(piece["vector"].chunk(0))
            filters = _padded(piece["filters"].chunk(0))
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            counts = np.zeros(len(ids), np.int64)
            labels = np.arange(len(ids))
            edge = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            left = np.repeat(np.r_[edge[1:], len(runs)], np.diff(np.r_[edge, len(runs)])) - np.arange(len(runs))
            size = np.diff(np.r_[edge, len(runs)])
            for at in np.flatnonzero(size >= DENSE).tolist():
                own_rows = slice(int(edge[at]), int(edge[at] + size[at]))
                near, new = _dense(rows[own_rows], filters[own_rows], int(own[edge[at]]), side[own_rows], least)
                counts[own_rows] += new @ n[own_rows]
                a, b = np.nonzero(near)
                labels = spanning_labels(len(ids), a + own_rows.start, b + own_rows.start, labels)
            active, step = np.flatnonzero(np.repeat(size < DENSE, size)), 1
            while len(active := active[left[active] > step]):
                for low in range(0, len(active), 4096):
                    a = active[low : low + 4096]
                    b = a + step
                    ok = np.einsum("ij,ij->i", rows[a], rows[b]) >= least
                    a, b = a[ok], b[ok]
                    if not len(a):
                        continue
                    labels = spanning_labels(len(ids), a, b, labels)
                    # a pair of chunks counts what lies across; a chunk with itself, all
                    a, b = (x[(side[a] < 0) | (side[a] != side[b])] for x in (a, b))
                    for at in range(0, len(a), 256):
                        p, q = a[at : at + 256], b[at : at + 256]
                        fp = np.where((filters[p] < own[p][:, None]) & (filters[p] >= 0), filters[p], -2)
                        earlier = (fp[:, :, None] == filters[q][:, None, :]).any(axis=(1, 2))
                        p, q = p[~earlier], q[~earlier]
                        np.add.at(counts, p, n[q])
                        np.add.at(counts, q, n[p])
                step += 1
            show = np.flatnonzero((counts > 0) | (labels != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[show]), pa.array(ids[labels[show]]), pa.array(counts[show])],
                names=["node", "other", "links"],
            )

    return run


def link_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    code: Code = Code(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile: int = 1024,
) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Rows link if their labels are equal and not null and their cosine, in double precision, is
    ``least`` or more.  A null vector or label, a zero vector, and one with a null or non-finite
    component link with nothing and stand alone.  Vectors of another length are a space of their
    own, of however many lengths there are.  Rows with a null id count as links of others and
    have the component of their class, null where all ids of it are.
    Equal vectors are folded first and count with their number.  An empty table gives an
    empty result.

    Each distinct vector is list-decoded to all filter directions it exceeds; vectors that
    share a filter (and label) meet in a run.  Filters that one vector alone exceeds are dropped
    by a count before vectors travel.  A run of over ``tile`` vectors is cut into chunks that meet
    pair by pair.  A pair meets at many filters; it is counted at its first common one.  At the
    threshold itself a pair has no common filter with a probability of about 1 in 1,000, also
    in few dimensions (measured in the tests); every pair found is exact.
    """
    spark = vectors.sparkSession
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).alias("vector"),
        usable(vectors, vector_col, label_col).alias("usable"),
    )
    folded = staged(
        source.where("usable")
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("rep", F.xxhash64("label", "vector"))
    )
    shortest, longest = folded.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if shortest is None:
        linked = spark.createDataFrame([], "rep long, links long, component_id long")
    else:
        rows = folded.select("rep", "vector")
        if shortest < longest:  # each task makes the books of a length once
            rows = rows.sortWithinPartitions(F.size("vector"))
        linked = _links(folded, rows.mapInArrow(_assign(code, least), "rep long, filter long"), least, tile)
    classes = folded.join(linked, "rep", "left").select(
        F.col("label").alias("_l"),
        F.col("vector").alias("_v"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    good = source.where("usable").join(
        classes, (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v"))
    )
    alone = source.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        good.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _links(folded: DataFrame, assigned: DataFrame, least: float, tile: int) -> DataFrame:
    """``rep``, ``links`` and ``component_id`` of the distinct vectors that have a link."""
    spark = folded.sparkSession
    spread = staged(
        assigned.join(folded.select("rep", "label", F.size("vector").alias("dim")), "rep").select(
            "rep", "filter", F.xxhash64("label", "dim", "filter").alias("key")
        )
    )
    shared = spread.groupBy("key").count().where("count > 1")
    met = spread.join(shared, "key").withColumn(
        "k", F.ceil(F.col("count") / F.lit(tile)).cast("int")
    )
    met = staged(met.select("rep", "filter", "key", "k"))
    lists = met.groupBy("rep").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    held = folded.select("rep", "vector", "n").join(lists, "rep")
    cut = met.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).withColumn(
        "j", F.explode(F.expr("sequence(0, k - 1)"))
    )
    tiles = cut.select(
        "rep",
        "filter",
        F.expr("if(k = 1, key, xxhash64(key, least(c, j), greatest(c, j)))").alias("run"),
        F.expr("if(k = 1, -1, c)").alias("side"),
        F.expr("k > 1 and c = j").alias("alone"),
    ).withColumn("side", F.expr("if(alone, -1, side)"))
    found = staged(
        tiles.drop("alone")
        .join(held, "rep")
        .repartition(tasks(spark), "run")
        .sortWithinPartitions("run")
        .select("run", "rep", "filter", "side", "vector", "n", "filters")
        .mapInArrow(_verify(least), "node long, other long, links long")
    )
    links = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    edges = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    # Components are of vectors; their name is the least id in them, null if all ids are.
    groups = components(edges)
    inside = groups.join(folded.select(F.col("rep").alias("node"), "first"), "node")
    named = inside.groupBy("component").agg(F.min("first").alias("component_id"))
    return (
        links.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .join(named, "component", "left")
        .select("rep", "links", "component_id")
    )
