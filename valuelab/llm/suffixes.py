"""Removal of byte passages that a document with a smaller id has too, by prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_runs, small_batches, staged, tasks, text_buffer

#: Anchors whose surroundings are looked at together.
STEP = 50_000
#: Length of a passage, half of it, and the places a passage has for a half.
LENGTH, HALF = 50, 25
PLACES = LENGTH - HALF + 1
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair of ranks."""
    x = (first ^ (first >> _S)) * _A + second * _B
    x ^= x >> _S
    x *= _A
    return x ^ (x >> _S)


def ranks(data: np.ndarray) -> np.ndarray:
    """Rank (a 64-bit name) of the 25 bytes from each position, by doubling along the last axis.

    Eight bytes are a number and so their own rank; pairs of ranks at offsets 8 and 9 give 16
    and 25 bytes.  Equal strings have equal ranks.
    """
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[..., :-step] | (x[..., step:] << np.uint64(8 * step))
    x = _pair(x[..., :-8], x[..., 8:])
    return _pair(x[..., :-9], x[..., 9:])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, slice_bytes: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose rank is least in some window of 26 positions, and their ranks.

    Every passage of 50 bytes has 26 places for 25 bytes, so it holds an anchor, and equal
    passages hold it at the same place.  Works in slices, whatever the length of a text.
    """
    size = len(data)
    places, names = [], []
    for at in range(0, max(0, size - LENGTH + 1), slice_bytes):
        low = max(0, at - PLACES + 1)
        high = min(size, at + slice_bytes + LENGTH + HALF)
        r = ranks(data[low:high])
        least = _window_min(r, PLACES)
        edge = np.zeros(PLACES - 1, np.uint64)
        highest = ~_window_min(~np.concatenate([edge, least, edge]), PLACES)
        p = np.flatnonzero(r == highest)
        last = size if at + slice_bytes + LENGTH > size else at + slice_bytes
        p = p[(p + low >= at) & (p + low < last)]
        places.append(p + low)
        names.append(r[p])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(names)


def _batch_anchors(ids: np.ndarray, data: np.ndarray, at: np.ndarray):
    """Rank, row and place in its text of every anchor of a batch, and the rows' ids."""
    places, names = anchors(data)
    row = np.searchsorted(at, places, "right") - 1
    inside = places + HALF <= at[row + 1]  # not over the end of its text
    inside &= at[row + 1] - at[row] >= LENGTH
    places, names, row = places[inside], names[inside], row[inside]
    return names, row, places - at[row], ids[row]


def _first_round(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rank, doc, place) of all anchors; ``place`` is n * 2**32 + pos.

    A rank that several documents of the batch have is known to repeat: only its first and
    last document are dealt by rank, with the number n of anchors they speak for, and the others
    (n = 0) go anywhere.  So a very frequent rank sends a few rows per batch to one task.
    """
    for batch in small_batches(batches, 1):
        data, at = text_buffer(batch.column(1))
        rank, _, pos, doc = _batch_anchors(batch.column(0).to_numpy(), data, at)
        n = np.ones(len(rank), np.int64)
        if len(rank):
            order = np.lexsort((doc, rank))
            by_rank, by_doc = rank[order], doc[order]
            start = np.flatnonzero(np.r_[True, by_rank[1:] != by_rank[:-1]])
            stop = np.r_[start[1:], len(rank)]
            wide = (stop - start > 2) & (by_doc[start] != by_doc[stop - 1])
            n[order[np.repeat(wide, stop - start)]] = 0
            n[order[start[wide]]] = (stop - start)[wide] - 1
            n[order[stop[wide] - 1]] = 1
            free = n == 0
            rank[free] = _pair(doc[free].astype(np.uint64), pos[free].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rank.view(np.int64)), pa.array(doc, pa.int64()), pa.array(n << 32 | pos)],
            names=["rank", "doc", "place"],
        )


def _repeated(hot: int):
    """Keeps the anchors whose rank two documents have; also names ranks with over ``hot`` anchors.

    Rows come in order of rank and are looked at in pieces that cut no rank.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in complete_runs(batches, "rank", 100_000):
            rank, doc, place = (piece[c].to_numpy() for c in ("rank", "doc", "place"))
            n, pos = place >> 32, place & 0xFFFFFFFF
            free = n == 0
            out = [(doc[free], pos[free], np.zeros(free.sum(), np.int64))]
            rank, doc, pos, n = (x[~free] for x in (rank, doc, pos, n))
            if len(rank):
                start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
                size = np.diff(np.r_[start, len(rank)])
                many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
                keep = np.repeat(many, size)
                out.append((doc[keep], pos[keep], np.zeros(keep.sum(), np.int64)))
                big = start[many & (np.add.reduceat(n, start) > hot)]
                out.append((doc[big], np.full(len(big), -1), rank[big]))
            for d, p, r in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d), pa.array(p.astype(np.int32)), pa.array(r)], names=["doc", "pos", "rank"]
                )

    return run


CONTEXT = "rank long, doc long, key long, pos int, mask int, context binary"


def _contexts(id_at: int, text_at: int, key_at: int, pos_at: int):
    """Second round: the 25 bytes before and the 25 bytes after each kept anchor.

    One row per anchor: rank, doc, key (tells apart texts that share a doc), pos, ``mask`` (bit r: a passage may start r bytes before
    the anchor) and those 50 bytes; the 25 bytes between them are what the rank names.  If another document of the batch with a smaller id has the same
    bytes there, the row is settled at once: it goes out without bytes, its mask the places
    to remove.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at):
            ids, keys = batch.column(id_at).to_numpy(), batch.column(key_at).to_numpy()
            data, at = text_buffer(batch.column(text_at))
            lists = batch.column(pos_at)
            row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            pos = lists.flatten().to_numpy().astype(np.int64)
            size = (at[1:] - at[:-1])[row]
            fits = (pos + HALF <= size) & (size >= LENGTH)
            row, pos, size = row[fits], pos[fits], size[fits]
            padded = np.concatenate([np.zeros(HALF, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            for low in range(0, len(pos), STEP):
                yield _context_rows(
                    padded, at, ids, keys, row[low : low + STEP], pos[low : low + STEP], size[low : low + STEP]
                )

    return run


def _context_rows(padded, at, ids, keys, row, pos, size) -> pa.RecordBatch:
    begin = at[row] + pos
    # Bytes of other texts count as zero, so that equal contexts compare equal.
    offset = np.r_[np.arange(-HALF, 0), np.arange(HALF, LENGTH)]
    context = padded[begin[:, None] + HALF + offset]
    context[(offset < -pos[:, None]) | (offset >= (size - pos)[:, None])] = 0
    doc = ids[row]
    r = np.arange(PLACES)
    valid = (r <= pos[:, None]) & (pos[:, None] - r + LENGTH <= size[:, None])
    mask = (valid * (1 << r)).sum(axis=1).astype(np.int64)
    name = ranks(padded[begin[:, None] + HALF + np.arange(HALF)])[:, 0]
    before, after = ranks(context[:, :HALF])[:, 0], ranks(context[:, HALF:])[:, 0]
    whole = _pair(_pair(before, after), _pair(name, mask.astype(np.uint64)))
    order = np.lexsort((doc, whole))
    same = np.r_[False, whole[order][1:] == whole[order][:-1]]
    group = np.cumsum(~same) - 1
    first = order[np.flatnonzero(~same)][group]
    settled = np.zeros(len(doc), bool)
    settled[order] = (doc[order] > doc[first]) & (context[order] == context[first]).all(axis=1) & (name[order] == name[first])
    settled &= mask > 0
    keep = mask > 0
    rank = name.view(np.int64).copy()
    body = [None if s else c.tobytes() for s, c in zip(settled[keep].tolist(), context[keep])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rank[keep]),
            pa.array(doc[keep], pa.int64()),
            pa.array(keys[row][keep], pa.int64()),
            pa.array(pos[keep].astype(np.int32)),
            pa.array(mask[keep].astype(np.int32)),
            pa.array(body, pa.binary()),
        ],
        names=["rank", "doc", "key", "pos", "mask", "context"],
    )


def _matrix(column: pa.Array) -> np.ndarray:
    data, at = text_buffer(column)
    return data.reshape(len(at) - 1, LENGTH)


def _passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third round: a passage is named by the pair of its anchor's rank and the rank of its other
    25 bytes; the least document with a pair keeps it.  Gives (doc, key, pos, mask) of what goes."""
    for part in complete_runs(batches, "rank", 20_000):
        doc, mask = part["doc"].to_numpy(), part["mask"].to_numpy()
        done = np.asarray(part["context"].chunk(0).is_null())
        out = np.where(done, mask, 0).astype(np.int64)
        open_ = np.flatnonzero(~done)
        if len(open_):
            open_ = open_[np.lexsort((doc[open_], part["rank"].to_numpy()[open_]))]
            d, m, k = doc[open_], mask[open_], part["rank"].to_numpy()[open_].view(np.uint64)
            around = ranks(_matrix(part["context"].chunk(0).take(pa.array(open_))))
            for r in range(PLACES):
                has = np.flatnonzero(m >> r & 1)
                if len(has) == 0:
                    continue
                a, b = k[has], around[has, HALF - r]
                name = _pair(a, b)
                by = np.argsort(name, kind="stable")  # rows of a name stay in order of doc
                new = np.r_[
                    True,
                    (name[by][1:] != name[by][:-1])
                    | (a[by][1:] != a[by][:-1])
                    | (b[by][1:] != b[by][:-1]),
                ]
                least = d[has[by[np.flatnonzero(new)]]][np.cumsum(new) - 1]
                more = has[by[d[has[by]] > least]]
                out[open_[more]] |= 1 << r
        hit = out > 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[hit]),
                part["key"].chunk(0).filter(pa.array(hit)),
                part["pos"].chunk(0).filter(pa.array(hit)),
                pa.array(out[hit].astype(np.int32)),
            ],
            names=["doc", "key", "pos", "mask"],
        )


def _each_passage(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, doc, key, pos, bit) of every passage of the contexts: its two ranks and its place."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            done = np.asarray(part.column(5).is_null())
            rank, doc, key, pos, mask = (part.column(i).to_numpy() for i in range(5))
            rows = np.flatnonzero(~done)
            around = ranks(_matrix(part.column(5).take(pa.array(rows))))
            has, r = np.nonzero(mask[rows, None] >> np.arange(PLACES) & 1)
            a, b, at = rank[rows[has]], around[has, HALF - r], rows[has]
            none = np.zeros(done.sum(), np.int64)
            parts = [
                (a, b.view(np.int64), doc[at], key[at], pos[at], 1 << r),
                (none, none, doc[done], key[done], pos[done], -mask[done]),
            ]
            for x in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in x[:4]] + [pa.array(np.asarray(v, np.int32)) for v in x[4:]],
                    names=["a", "b", "doc", "key", "pos", "bit"],
                )


def _hot_masks(contexts: DataFrame) -> DataFrame:
    """(doc, key, pos, mask) for anchors of very frequent ranks, by grouping single passages.

    The least document of a passage is a combining aggregate, and it returns to the rows by a
    join whose large side Spark may split, so no task holds all rows of such a rank.
    """
    each = staged(contexts.mapInArrow(_each_passage, "a long, b long, doc long, key long, pos int, bit int"))
    open_ = each.where("bit > 0")
    least = open_.groupBy("a", "b", "bit").agg(F.min("doc").alias("least"))
    found = open_.join(least, ["a", "b", "bit"]).where("doc > least").select("doc", "key", "pos", "bit")
    settled = each.where("bit < 0").select("doc", "key", "pos", (-F.col("bit")).alias("bit"))
    return found.unionByName(settled).groupBy("doc", "key", "pos").agg(F.bit_or("bit").alias("mask"))


def _cut(names: list[str], text_at: int, marks_at: int):
    """Last round: cuts the marked passages out of each text and reports what was done."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(PLACES)
        for batch in small_batches(batches, text_at):
            data, at = text_buffer(batch.column(text_at))
            whole, at = data.tobytes(), at.tolist()
            texts: list[str | None] = []
            report: list[tuple] = []
            marks = batch.column(marks_at)
            bounds = marks.offsets.to_numpy().tolist()
            flat = marks.values
            pos, mask = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for i, (a, b) in enumerate(zip(at, at[1:])):
                text = whole[a:b]
                spans: list[dict] = []
                low, high = bounds[i], bounds[i + 1]
                if high > low and marks.is_valid()[i].as_py():
                    which, r = np.nonzero(mask[low:high, None] >> bits & 1)
                    starts = pos[low:high][which] - r
                    size = b - a
                    starts = starts[(starts >= 0) & (starts + LENGTH <= size)]
                    edge = np.bincount(starts, minlength=size + 1) - np.bincount(
                        starts + LENGTH, minlength=size + 1
                    )
                    gone = np.concatenate([[False], np.cumsum(edge[:size]) > 0, [False]])
                    turn = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                    spans = [{"start": s, "end": e} for s, e in zip(turn[::2], turn[1::2])]
                    edges = [0, *turn, size]
                    text = b"".join(text_part(whole, a, s, e) for s, e in zip(edges[::2], edges[1::2]))
                texts.append(text.decode("utf-8", "ignore") if spans else None)
                report.append(
                    (b - a, b - a - len(text), len(spans), hashlib.sha256(text).hexdigest(), spans)
                )
            old = batch.column(text_at)
            kept = pa.array(texts, pa.string())
            changed = pa.array([bool(x[4]) for x in report], pa.bool_())
            new = pa.compute.if_else(changed, kept, old.cast(pa.string()))
            columns = [
                new if i == text_at else batch.column(i) for i in range(len(names))
            ]
            extra = list(zip(*report)) if report else [(), (), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(x, k) for x, k in zip(extra, kinds)],
                names=[*names, *REPORT],
            )

    def text_part(whole: bytes, base: int, start: int, end: int) -> bytes:
        return whole[base + start : base + end]

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
REPORT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
REPORT_DDL = (
    "n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<start: long, end: long>>"
)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 250_000
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and a report beside them.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id.
    Strings are judged on the input and never cross documents.  Columns ``id``, ``text`` and
    ``rest`` (a struct of the other columns), then ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``spans`` (byte ranges removed).  A null text is empty and stays null.
    Rows with one id do not remove from each other, each loses what is repeated in its own text;
    a row with a null id neither removes nor loses.  Kept bytes that no longer form a whole character are left out of the text, not
    out of the hash.  An empty table gives an empty result.

    Prefix doubling, cut short: ranks of 8, 16 and 25 bytes are named inside each text, so
    doubling needs no join.  Round one keeps only anchors (about one position in thirteen;
    every passage holds one) and lets Spark bring equal ranks together: positions whose rank
    no other document has are dropped.  Round two takes the bytes around the rest, round three
    brings pairs of the anchor's rank and its surroundings' rank, so 50 bytes, together.  Ranks with over ``hot`` anchors go
    through a combining aggregate instead of one task; both ways are exact.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.lit(None).cast("struct<none: int>")
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest")
    )
    named = plain.where("id is not null")
    # Texts that share an id are told apart by a hash; where none do, which a combining count
    # over ids shows, the key is zero throughout and takes no room.
    mark = F.xxhash64("text")
    shared = (
        named.select("id", mark.alias("m")).groupBy("id").agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a <> b")
    )
    named = named.withColumn("key", F.lit(0).cast("long") if shared.isEmpty() else mark)
    first = named.select("id", "text").mapInArrow(_first_round, "rank long, doc long, place long")
    kept = staged(
        first.repartition(tasks(spark), "rank")
        .sortWithinPartitions("rank")
        .mapInArrow(_repeated(hot), "doc long, pos int, rank long")
    )
    places = kept.where("pos >= 0").groupBy("doc").agg(F.collect_list("pos").alias("places"))
    frequent = kept.where("pos < 0").select("rank").distinct()
    around = (
        named.join(places, named["id"] == places["doc"])
        .select("id", "text", "key", "places")
        .sortWithinPartitions("id")
        .mapInArrow(_contexts(0, 1, 2, 3), CONTEXT)
    )
    has_frequent = not frequent.isEmpty()
    normal = around.join(frequent, "rank", "left_anti") if has_frequent else around
    route = F.expr("if(context is null, xxhash64(doc, key, pos), rank)")
    marks = staged(
        normal.repartition(tasks(spark), route)
        .sortWithinPartitions("rank")
        .mapInArrow(_passages, "doc long, key long, pos int, mask int")
    )
    if has_frequent:
        marks = marks.unionByName(_hot_masks(around.join(frequent, "rank", "left_semi")))
    marked = (
        marks.groupBy("doc", F.col("key").alias("of")).agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))
    )
    empty = F.expr("cast(array() as array<struct<pos: int, mask: int>>)")
    own = (named["id"] == marked["doc"]) & (named["key"] == marked["of"])
    joined = named.join(marked, own, "left").select(
        "id", "text", "rest", F.coalesce("marks", empty).alias("marks")
    )
    nameless = plain.where("id is null").withColumn("marks", empty)
    names = ["id", "text", "rest"]
    kind = plain.schema["rest"].dataType.simpleString()
    schema = f"id long, text string, rest {kind}, {REPORT_DDL}"
    return joined.mapInArrow(_cut(names, 1, 3), schema).unionByName(
        nameless.mapInArrow(_cut(names, 1, 3), schema)
    )
