"""Packing of tokenised documents into sequences by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_buffer
from .tokens import ByteEncoder, kept


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold.

    ``documents`` bounds the pieces in a sequence and ``attention`` the sum of their squared
    lengths; None stands for a bound that tokens alone imply.  ``score`` is how a bin is
    selected: ``norm`` takes the least residual, ``dot`` the residual most in line with
    the piece's demand.  ``weights`` are those of tokens, documents and attention.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    score: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def vector(self) -> np.ndarray:
        return np.array(
            [self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float
        )


PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces with the
    shorter one, if any, first."""
    if n <= size:
        return [(0, n)]
    first = n % size
    starts = [0] if first else []
    starts += range(first, n, size)
    return [(s, first if s == 0 and first else size) for s in starts]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    size: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece of each document's ids, the end id included.

    ``row`` numbers the input rows, so that rows with the same id stay apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(ByteEncoder, tokenizer)
        for batch in batches:
            data, at = text_buffer(batch.column(2))
            whole, at = data.tobytes(), at.tolist()
            doc, row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for d, r, a, b in zip(doc, row, at, at[1:]):
                ids = np.append(encoder.encode(whole[a:b].decode()), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut_lengths(len(ids), size)):
                    part = ids[start : start + length]
                    values = (d, r, k, start, length, zlib.crc32(part.tobytes()), part if with_ids else None)
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(out[6], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    return source.mapInArrow(run, PIECE + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: vector best-fit, longest pieces first.

    Bins with the same residual vector are alike, so a state keeps them as one list, and all
    pieces of one length go to states, not to bins one by one.  A piece goes to an open bin
    only if tokens, documents and attention all fit; of those it takes the best by score.
    """
    full = capacity.vector()
    weights = np.array(capacity.weights)
    order = np.argsort(-lengths, kind="stable")
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    number: dict[tuple[int, int, int], int] = {}  # of the states seen so far
    states = np.zeros((1024, 3))
    filled = np.zeros(1024, bool)  # states that have bins
    own: list[list[int]] = []
    bins = 0

    def put(state: tuple[int, int, int], chosen: list[int]) -> None:
        nonlocal states, filled
        k = number.get(state)
        if k is None:
            k = number[state] = len(own)
            own.append([])
            if k == len(states):
                states = np.concatenate([states, np.zeros_like(states)])
                filled = np.concatenate([filled, np.zeros_like(filled)])
            states[k] = state
        own[k].extend(chosen)
        filled[k] = True

    values, starts, counts = np.unique(-lengths[order], return_index=True, return_counts=True)
    for value, at, count in zip((-values).tolist(), starts.tolist(), counts.tolist()):
        demand = np.array([value, 1, value * value], float)
        if (full < demand).any():
            raise ValueError(f"a piece of {value} tokens fits no empty sequence")
        todo = order[at : at + count]
        done = 0
        while done < count:
            fits = np.flatnonzero(filled[: len(own)])
            fits = fits[(states[fits] >= demand).all(axis=1)]
            if len(fits):
                left = (states[fits] - demand) / full
                merit = -np.sqrt((weights * left**2).sum(axis=1))
                if capacity.score == "dot":  # the residual most in line with the demand
                    along = (weights * states[fits] / full * demand / full).sum(axis=1)
                    merit = along / (1e-9 - merit)
                ranked = fits[np.argsort(-merit, kind="stable")].tolist()
            else:
                each = max(1, int((full // demand).min()))  # of this length in one bin
                need = -(-(count - done) // each)
                put(tuple(full.astype(int).tolist()), list(range(bins, bins + need)))
                bins += need
                ranked = [number[tuple(full.astype(int).tolist())]]
            for k in ranked:  # the merits of other states stay as they are
                n = min(len(own[k]), count - done)
                chosen = own[k][-n:]
                del own[k][-n:]
                filled[k] = bool(own[k])
                state = states[k].astype(int).tolist()
                sequence[todo[done : done + n]] = chosen
                offset[todo[done : done + n]] = int(full[0]) - state[0]
                done += n
                after = (state[0] - value, state[1] - 1, state[2] - value * value)
                if after[0] > 0 and after[1] > 0 and after[2] > 0:
                    put(after, chosen)
                if done == count:
                    break
    return sequence, offset


def pack(parts: DataFrame, capacity: Capacity = Capacity(), group: int = 50_000) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Pieces are dealt by a hash into groups of about ``group``, each packed in a task of its
    own: a group sees every length in its usual share, so it loses a sequence or so against
    packing all at once.  Only lengths and numbers travel.  Sequence ids are the group's number
    followed by the sequence's; they have gaps.  An empty table gives an empty result.
    """
    fixed = staged(parts)
    n = fixed.count()
    groups = max(1, -(-n // group))
    columns = [c for c in fixed.columns if c != "ids"]
    kinds = {f.name: f.dataType.simpleString() for f in fixed.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in columns)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"], kind="stable")
        sequence, offset = best_fit(frame["length"].to_numpy(), capacity)
        base = int(frame["_group"].iloc[0]) << 32
        return frame[columns].assign(sequence_id=base + sequence, offset=offset)

    packed = (
        fixed.select(*columns, F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("_group"))
        .groupBy("_group")
        .applyInPandas(run, f"{ddl}, sequence_id long, offset long")
    )
    if "ids" in fixed.columns:
        return packed.join(fixed.select("row", "piece", "ids"), ["row", "piece"])
    return packed


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: Capacity = Capacity(),
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = 50_000,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: ``doc_id``, ``row``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` (and ``ids``, if asked for).

    A null text is empty: its document is the end id alone.  A document longer than a sequence
    is cut into full pieces, the first may be shorter; no other is cut.  Null and repeated
    document ids keep rows of their own.
    """
    parts = pieces(docs, tokenizer, end_id, capacity.tokens, id_col, text_col, with_ids)
    return pack(parts, capacity, group)
