"""Language identification: sparse multinomial logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer

#: Answer for a text without letters.
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample`` and ``calibration`` bound the texts a model is fitted on, ``sample_bytes`` their
    total size, ``longest`` the bytes of one of them (longer texts are not fitted on).

    Everything else (document frequencies, predictions) covers all rows and whole texts.
    """

    bits: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    sample: int = 3000
    calibration: int = 1000
    sample_bytes: int = 24_000_000
    longest: int = 200_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    seed: int = 7


def letter_table() -> np.ndarray:
    """For each character of the first plane: itself if it is a letter or a mark, else a space."""
    return np.array(
        [c if chr(c).isalpha() or 0x300 <= c < 0x370 else 32 for c in range(1 << 16)], np.uint32
    )


def features(text: str, fold: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """Hashed ids of one text's character n-grams, an array for each order.

    Letters are lowered; whatever is no letter counts as a space, and spaces in a row as one,
    so the edges of words are features.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < len(fold), fold[np.minimum(codes, len(fold) - 1)], codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    out = []
    shift = np.uint32(32 - settings.bits)
    gram = codes
    for order in range(1, max(settings.orders) + 1):
        if order > 1:
            gram = gram[:-1] * np.uint32(0x01000193) + codes[order - 1 :]
        if order in settings.orders and len(gram):
            hashed = (gram + np.uint32(order)) * np.uint32(2654435761)
            hashed ^= hashed >> np.uint32(15)
            out.append(((hashed * np.uint32(2246822519)) >> shift).astype(np.int32))
    return out


@dataclass
class Model:
    """``weights``: idf times coefficient for each feature and language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings

    def probabilities(self, parts: list[np.ndarray]) -> np.ndarray:
        total = sum(map(len, parts))
        score = self.bias.copy()
        if total:
            for part in parts:
                counts = np.bincount(part, minlength=1) if len(part) > 4096 else None
                if counts is None:
                    score += self.weights[part].sum(axis=0) / total
                else:
                    score += counts @ self.weights[: len(counts)] / total
        score = score / self.temperature
        score = np.exp(score - score.max())
        return score / score.sum()


def document_frequencies(rows: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows; and the number of rows.

    Each task keeps one vector of ``2 ** bits`` counts; Spark adds the vectors' entries.  What
    reaches the driver is that one vector, whose length is fixed.
    """
    size = 1 << settings.bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = letter_table()
        counts = np.zeros(size, np.int64)
        seen = np.zeros(size, bool)
        n = 0
        for batch in batches:
            data, at = text_buffer(batch.column(0))
            whole, at = data.tobytes(), at.tolist()
            n += batch.num_rows
            for a, b in zip(at, at[1:]):
                seen[:] = False
                for part in features(whole[a:b].decode(), fold, settings):
                    seen[part] = True
                counts += seen
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[found, -1].astype(np.int32)), pa.array(np.r_[counts[found], n])],
            names=["feature", "n"],
        )

    total = rows.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counts, n = np.zeros(size), 0
    for feature, found in total.collect():
        if feature < 0:
            n = found
        else:
            counts[feature] = found
    return counts, n


def _sample(rows: DataFrame, settings: Settings) -> list[tuple[bytes, str]]:
    """A bounded sample of labelled rows, the same number for each language where it has them.

    Rows are taken in order of a seeded hash of their content until the documented bounds; a
    text that occurs again is taken once.
    """
    each = settings.sample + settings.calibration
    mark = F.xxhash64(F.lit(settings.seed), "text")
    fit = rows.where(F.octet_length("text") <= settings.longest).select("text", "lang", mark.alias("mark"))
    # Copies count once: by the hash of the text, which is all that is shuffled.
    texts = fit.select("lang", "mark").distinct()
    counts = texts.groupBy("lang").count().orderBy("lang").limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError("over 1,000 languages: set a coarser label")
    if not counts:
        return []
    share = max(1, each // len(counts))
    # A row is picked if its hash lies in its language's part of the range.  That part gives
    # the share and a little more, so few rows reach the driver, whatever their number was.
    part = {lang: min(1.0, (share + 4 * share**0.5 + 4) / n) for lang, n in counts}
    listed = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])
    place = F.shiftrightunsigned("mark", 11).cast("double") / F.lit(2.0**53)
    picked = (
        fit.where(place < F.element_at(listed, F.col("lang")))
        .dropDuplicates(["lang", "mark"])
        .select(F.col("text").cast("binary").alias("text"), "lang", "mark")
        .collect()
    )
    out: list[tuple[bytes, str]] = []
    for lang, _ in counts:
        left, taken, before = settings.sample_bytes // len(counts), 0, None
        for row in sorted((r for r in picked if r.lang == lang), key=lambda r: (r.mark, bytes(r.text))):
            if row.text == before:  # copies share a hash and would crowd out the rest
                continue
            before = row.text
            left -= len(row.text)
            if left < 0 or taken == share:
                break
            taken += 1
            out.append((bytes(row.text), lang))
    return out


def train(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on ``rows`` with columns ``text`` and ``lang`` (both not null).

    FTRL-proximal updates with L1 and L2 penalties, one document a step, then one temperature
    that minimises log loss on the sample's calibration part.  No rows: a model without
    languages, which answers ``und``.
    """
    sample = _sample(rows, settings)
    languages = sorted({language for _, language in sample})
    size = 1 << settings.bits
    if not languages:
        return Model([], np.zeros((size, 1)), np.zeros(1), 1.0, settings)
    frequency, n = document_frequencies(rows.select("text"), settings)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    random = np.random.default_rng(settings.seed)
    order = random.permutation(len(sample))
    cut = max(1, int(len(order) * settings.sample / (settings.sample + settings.calibration)))
    k = len(languages)
    number = {language: i for i, language in enumerate(languages)}

    fold = letter_table()

    def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        parts = features(text.decode(), fold, settings)
        joined = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ids, counts = np.unique(joined, return_counts=True)
        return ids, counts / max(1, len(joined)) * idf[ids] * SCALE

    encoded = [(vector(sample[i][0]), number[sample[i][1]]) for i in order.tolist()]
    z, g2 = np.zeros((size, k)), np.zeros((size, k))
    bias = np.zeros(k)

    def coefficients(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        rate = (settings.beta + np.sqrt(g2[ids])) / settings.alpha + settings.l2
        return -np.sign(zi) * np.maximum(np.abs(zi) - settings.l1, 0) / rate

    for _ in range(settings.epochs):
        for (ids, values), label in encoded[:cut]:
            w = coefficients(ids)
            score = values @ w + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            gradient = values[:, None] * p
            g2_new = g2[ids] + gradient**2
            sigma = (np.sqrt(g2_new) - np.sqrt(g2[ids])) / settings.alpha
            z[ids] += gradient - sigma * w
            g2[ids] = g2_new
    w = coefficients(np.arange(size))
    held = encoded[cut:] or encoded
    scores = np.array([values @ w[ids] for (ids, values), _ in held])
    labels = np.array([label for _, label in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), labels] - np.log(np.exp(s).sum(axis=1))).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return Model(languages, w * idf[:, None] * SCALE, bias, temperature, settings)


#: Scales relative frequencies to numbers near one, so that penalties have their usual size.
SCALE = 30.0


def held_out(id_col: str):
    """Documents that training leaves aside: one in five, by checksum of the id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    settings: Settings = Settings(),
) -> Model:
    """Learns from documents that are not held out and have a language and a text."""
    rows = docs.where(~F.coalesce(held_out(id_col), F.lit(False))).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return train(rows.where("text is not null and lang is not null"), settings)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string) and ``score`` (the calibrated probability).

    Only the text is an input.  A null text, or one without a letter, is ``und`` with score 0.
    Ties go to the first language in alphabetical order.  Other columns named so are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.weights.astype(np.float32), model.bias, model.temperature, model.settings)
    )
    text_at = kept.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, fold = Model(*shared.value), letter_table()
        for batch in batches:
            data, at = text_buffer(batch.column(text_at))
            letters = batch.column(len(kept)).to_pylist()
            whole, at = data.tobytes(), at.tolist()
            found, scores = [], []
            for a, b, has in zip(at, at[1:], letters):
                if not has or not local.languages:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = local.probabilities(features(whole[a:b].decode(), fold, local.settings))
                best = int(np.argmax(p))
                found.append(local.languages[best])
                scores.append(float(min(1.0, p[best])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))]
                + [pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    schema = docs.select(*kept).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return source.mapInArrow(run, f"{ddl}, lang_pred string, score double")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    settings: Settings = Settings(),
) -> DataFrame:
    """Trains on the documents that are not held out and predicts all: ``doc_id``,
    ``held_out``, ``lang_pred``, ``score``.  A null id is not held out."""
    model = fit_documents(docs, id_col, text_col, lang_col, settings)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model).select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def keep_identified(docs: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The documents whose language is recognised with a probability of ``least`` or more."""
    model = fit_documents(docs, **how)
    columns = docs.columns
    return (
        predict(docs, model, how.get("text_col", "text"))
        .where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
        .select(*columns)
    )
