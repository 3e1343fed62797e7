"""Spelling variants: words one edit apart, found by scanning sorted lists with banded edit rows.

Two words one edit apart share the front or the back half of the shorter one, so Spark deals the
vocabulary by such halves and sorts each list by the letters that are left.  A list is then
scanned like a dictionary: words that begin alike share the rows of the edit matrix up to their
longest common prefix, and where the least entry of a row passes one edit, all words with that
prefix are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, tasks, text_buffer
from .leaks import LOWER, UPPER

#: What parts runs of letters.
NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
#: Length of a list from which it is dealt again by more letters.  A list whose words differ in
#: one place of the shorter word has 90 + 90**2 words at most, so no list stays longer.
LONG_LIST = 10_000
#: Rows of lists for one task.
TASK_ROWS = 200_000
#: Pairs of a word and a prefix that are held together.
PAIRS = 4_000_000
#: Stands for "no limit" of a common prefix.
ANY = 1 << 30


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5) -> DataFrame:
    """``id`` and ``run`` (A-Z lower-cased) of each maximal run of at least ``least`` letters."""
    cut = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.split(F.col(text_col), NOT_LETTERS)).alias("run"),
    )
    plain = F.octet_length("run") == F.length("run")
    low = F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    return cut.where(F.length("run") >= least).select("id", low.alias("run"))


def misspelt(found: DataFrame, one_in: int = 97) -> DataFrame:
    """``word`` of each run: where ``one_in`` divides the CRC-32 of ``<id>:<run>``, the run without
    the code point at that number modulo its length."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    less = F.concat(F.expr("left(run, at)"), F.expr("substr(run, at + 2)"))
    return found.select("run", h.alias("h"), at.alias("at")).select(
        F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")
    )


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word`` and ``n``: words of enough code points that occur often enough."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# Dealing the vocabulary into lists


def _lists(vocab: DataFrame) -> DataFrame:
    """Every word on the four lists where its neighbours can be.

    ``short`` is the length of the shorter word of a pair, ``front`` and ``back`` the numbers of
    letters that all words of the list share at their ends.  A pair whose front half is shared is
    found there; its back list passes it over (``below``: pairs of the list have fewer common
    letters in front than that), so each pair counts once.
    """
    size = F.length("word")
    both = F.inline(F.array(*[F.struct((size - less).alias("short"), size.alias("size")) for less in (0, 1)]))
    tagged = vocab.select("word", "n", both).where("short > 0")
    half = F.expr("short div 2").cast("int")
    none = F.lit(0)
    ways = F.array(
        F.struct(half.alias("front"), none.alias("back"), F.lit(ANY).alias("below")),
        F.struct(none.alias("front"), half.alias("back"), half.alias("below")),
    )
    return tagged.select("word", "n", "size", "short", F.inline(ways))


def _deeper(rows: DataFrame) -> DataFrame:
    """The words of long lists, dealt again: half of what is left has to be shared too."""
    half = F.expr("(short - front - back) div 2").cast("int")
    more = (F.col("front") + half).cast("int")
    ways = F.array(
        F.struct(more.alias("f"), F.col("back").alias("b"), F.col("below").alias("t")),
        F.struct(F.col("front").alias("f"), (F.col("back") + half).alias("b"), F.least("below", more).alias("t")),
    )
    out = rows.select("word", "n", "size", "short", F.inline(ways))
    return out.select(
        "word", "n", "size", "short", F.col("f").alias("front"), F.col("b").alias("back"), F.col("t").alias("below")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    shared = (F.expr("left(word, front)"), F.expr("right(word, back)"))
    return rows.withColumn("list", F.xxhash64("short", "front", "back", "below", *shared))


def dealt(vocab: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """``word``, ``n``, ``size``, ``short``, ``front``, ``back``, ``below`` and ``list`` of all lists.

    Lists longer than ``long_list`` are dealt again by more shared letters until none is, or all
    that is left to differ is one letter.  How long lists are is a combining count.
    """
    open_ = _keyed(_lists(vocab))
    out = None
    while True:
        long = open_.groupBy("list", "short", "front", "back").count()
        long = staged(long.where((F.col("count") > long_list) & (F.col("short") - F.col("front") - F.col("back") > 1)))
        if long.isEmpty():
            return open_ if out is None else out.unionByName(open_)
        names = long.select("list")
        done = open_.join(names, "list", "left_anti")
        out = done if out is None else out.unionByName(done)
        open_ = staged(_keyed(_deeper(open_.join(names, "list", "left_semi").drop("list"))))


# Scanning sorted lists


def _letters(words: pa.Array, width: int) -> np.ndarray:
    """One row of Latin-1 letters per word, zero beyond its end."""
    data, at = text_buffer(words)
    out = np.zeros((len(at) - 1, width), np.uint8)
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - np.repeat(at[:-1], size)] = data
    return out


def scan(letters: np.ndarray, size: np.ndarray, lists: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of pairs one edit apart in lists of sorted words of ``short`` and ``short`` + 1 letters.

    ``lists`` numbers the list of each row, in order.  The first of a pair has ``short`` letters;
    if both have, the pair comes twice, once from either side.  A step takes all pairs of a word
    and a prefix of the list to prefixes one letter longer: a row of the matrix is the three
    entries around the diagonal, computed once for all words with that prefix.
    """
    rows = len(size)
    if rows == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_list = np.r_[True, lists[1:] != lists[:-1]]
    differ = letters[1:] != letters[:-1]
    common = np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), short + 1)]
    common[new_list] = -1
    # Prefixes of each depth by the first row that has them, and their children one letter on.
    starts = [np.flatnonzero(new_list)]
    for depth in range(1, short + 2):
        starts.append(np.flatnonzero((common < depth) & (size >= depth)))
    children = []
    for above, below in zip(starts, starts[1:]):
        first = np.searchsorted(below, above)
        children.append((first, np.diff(np.r_[first, len(below)])))
    length = np.diff(np.r_[starts[0], rows])
    asking = np.flatnonzero(size == short)
    own = np.searchsorted(starts[0], asking, "right") - 1
    alone = length[own] == 1
    asking, own = asking[~alone], own[~alone]
    found_a, found_b = [], []
    load = np.cumsum(length[own])
    low = 0
    while low < len(asking):
        high = max(low + 1, int(np.searchsorted(load, (load[low - 1] if low else 0) + PAIRS, "right")))
        a, b = _walk(letters, size, starts, children, asking[low:high], own[low:high], short)
        found_a += a
        found_b += b
        low = high
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _walk(letters, size, starts, children, word, node, short):
    """Descends from the lists' empty prefixes; see :func:`scan`."""
    before = np.full(len(word), 2, np.uint8)
    at = np.zeros(len(word), np.uint8)
    after = np.ones(len(word), np.uint8)
    found_a, found_b = [], []
    width = letters.shape[1]
    for depth in range(short + 1):
        first, count = (x[node] for x in children[depth])
        total = int(count.sum())
        if total == 0:
            break
        up = np.repeat(np.arange(len(node)), count)
        child = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
        row = starts[depth + 1][child]
        c, w = letters[row, depth], word[up]

        def costs(place):
            if place < 0 or place >= width:
                return np.ones(total, np.uint8)
            return (letters[w, place] != c).astype(np.uint8)

        b, m, e = before[up], at[up], after[up]
        before_new = np.minimum(b + costs(depth - 1), m + 1)
        at_new = np.minimum(np.minimum(m + costs(depth), e + 1), before_new + 1)
        after_new = np.minimum(e + costs(depth + 1), at_new + 1)
        keep = np.flatnonzero(np.minimum(np.minimum(before_new, at_new), after_new) <= 1)
        word, node = w[keep], child[keep]
        before, at, after = before_new[keep], at_new[keep], after_new[keep]
        # Words that end here: the entry at the asking word's own length.
        if depth + 1 >= short:
            entry = at if depth + 1 == short else before
            row = starts[depth + 1][node]
            hit = (entry == 1) & (size[row] == depth + 1)
            found_a.append(word[hit])
            found_b.append(row[hit])
    return found_a, found_b


FOUND = "word binary, near long, best_n long, best binary"


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lists in order of (list, letters): per word and list the number of near words, and of
    each length the one that occurs most often (ties: the first in order)."""
    for piece in _whole_lists(batches):
        kinds = np.stack([piece[c].to_numpy() for c in ("short", "front", "back", "below")], axis=1)
        same = np.unique(kinds, axis=0, return_inverse=True)
        for number, (short, front, back, below) in enumerate(same[0].tolist()):
            own = np.flatnonzero(same[1].reshape(-1) == number)
            part = piece.take(pa.array(own)).combine_chunks()
            yield _best(part, short, front, back, below)


def _best(part: pa.Table, short: int, front: int, back: int, below: int) -> pa.RecordBatch:
    words = part["word"].combine_chunks()
    size = part["size"].to_numpy()
    n = part["n"].to_numpy()
    letters = _letters(words, short + 2)
    lists = part["list"].to_numpy()
    # The letters that all words of a list share need no rows.
    inner = letters[:, front:]
    middle = inner.copy()
    place = np.arange(inner.shape[1])
    middle[place >= (size - front - back)[:, None]] = 0
    a, b = scan(middle, size - front - back, lists, short - front - back)
    # Not only the hash of what is shared has to be equal.
    true = (letters[a, :front] == letters[b, :front]).all(axis=1)
    for i in range(1, back + 1):
        true &= letters[a, size[a] - i] == letters[b, size[b] - i]
    if below < ANY:
        true &= ~(letters[a, :below] == letters[b, :below]).all(axis=1)
    a, b = a[true], b[true]
    longer = size[b] > short
    a, b = np.r_[a, b[longer]], np.r_[b, a[longer]]
    # Rows of one list and length are in the order of whole words.
    order = np.lexsort((b, -n[b], size[b], a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (size[b][1:] != size[b][:-1])][: len(a)])
    count = np.diff(np.r_[start, len(a)])
    return pa.RecordBatch.from_arrays(
        [
            words.take(pa.array(a[start])).cast(pa.binary()),
            pa.array(count.astype(np.int64)),
            pa.array(n[b[start]]),
            words.take(pa.array(b[start])).cast(pa.binary()),
        ],
        names=["word", "near", "best_n", "best"],
    )


def _whole_lists(
    batches: Iterable[pa.RecordBatch], least: int = 50_000, least_bytes: int = 16 << 20
) -> Iterator[pa.Table]:
    """Pieces of at least ``least`` rows or ``least_bytes`` that cut no list."""
    waiting, rows, held = [], 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        held += batch.nbytes
        if rows < least and held < least_bytes:
            continue
        joined = pa.Table.from_batches(waiting).combine_chunks()
        lists = joined["list"].to_numpy()
        turn = np.flatnonzero(lists[1:] != lists[:-1])
        if len(turn):
            cut = int(turn[-1]) + 1
            yield joined.slice(0, cut)
            waiting = joined.slice(cut).combine_chunks().to_batches()
            rows = joined.num_rows - cut
            held = sum(b.nbytes for b in waiting)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _latin(word: Column) -> Column:
    return F.encode(word, "ISO-8859-1")


def near_words(vocab: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """``word``, ``n_near``, ``best`` and ``best_n`` of the words that have a near word."""
    rows = dealt(vocab, long_list)
    parts = max(tasks(vocab.sparkSession), 4 * vocab.count() // TASK_ROWS)
    middle = F.expr("substr(word, front + 1, size - front - back)")
    numbers = [F.col(c).cast("long") for c in ("n", "size", "short", "front", "back", "below", "list")]
    found = (
        rows.select(_latin(F.col("word")).alias("word"), _latin(middle).alias("middle"), *numbers)
        .repartition(parts, "list")
        .sortWithinPartitions("list", "short", "front", "back", "below", "middle")
        .drop("middle")
        .mapInArrow(_neighbours, FOUND)
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    back = lambda c: F.decode(c, "ISO-8859-1")
    return (
        found.groupBy("word")
        .agg(F.sum("near").alias("n_near"), best.alias("b"))
        .select(back(F.col("word")).alias("word"), "n_near", back(F.col("b.best")).alias("best"), (-F.col("b.less")).alias("best_n"))
    )


def roots(forms: DataFrame, max_rounds: int = 10) -> DataFrame:
    """``word``, ``root`` of the words of ``forms`` (``word``, ``form``), by doubling of pointers.

    A form occurs at least twice as often as its word, so a chain has at most 63 steps and
    six rounds reach its end.  Each round is a table in the shared folder.
    """
    now = staged(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = staged(
            now.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), (F.col("further").isNotNull()).alias("moved"))
        )
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms do not end after {max_rounds} rounds")


def spelling_variants(vocab: DataFrame, ratio: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """One row per word of ``vocab`` (``word``, ``n``; distinct words of Latin-1 letters): ``word``,
    ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    Near words differ by one inserted, deleted or replaced code point.  The form is the near word
    that occurs most often (ties: the first in code-point order), if it occurs at least ``ratio``
    times as often; the root is where the chain of forms ends, the word itself if it has no form.
    An empty table gives an empty result.
    """
    vocab = staged(vocab.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(vocab, long_list)
    formed = F.col("best_n") >= F.col("n") * ratio
    told = staged(
        vocab.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 5,
    least_count: int = 3,
    one_in: int = 97,
    ratio: int = 2,
    long_list: int = LONG_LIST,
) -> DataFrame:
    """Spelling variants among the words of whole texts; see :func:`spelling_variants`.

    One run in ``one_in`` loses a letter first, chosen by a hash of id and run, so that the
    variants are known.  A null text has no words; a null id reads as an empty one.  Rows that
    repeat an id or a text count again.  Runs longer than any word are words like others.  An
    empty table gives an empty result.  Other columns are not read.
    """
    words = misspelt(runs(docs, id_col, text_col, least_length), one_in)
    return spelling_variants(vocabulary(words, least_length, least_count), ratio, long_list)
