"""The stages one after the other, on the smallest table, an empty one and odd rows; the whole run
against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from test_table_operators import brute_rake
from test_text_operators import brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from valuelab.llm import langid, mixing, packing
from valuelab.llm.common import spanning_labels, staged
from valuelab.llm.queries import MIX, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def through(spark, docs, sf):
    kept = []
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, sf))
        kept.append(docs)
    return kept


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, None, "en", "s", 0), (10**6 + 1, "123 !!", "en", "s", 7), (10**6 + 2, docs.first().text, "en", "s", 1)],
        docs.schema,
    )
    language, near, cut, mix, packed = through(spark, docs.unionByName(extra), sf)
    assert all(d.columns == COLUMNS for d in (language, near, cut, mix))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in (language, near, cut, mix, packed)]
    assert not ids[0] & {10**6, 10**6 + 1} and 10**6 + 2 in ids[0] - ids[1]
    assert ids[1] == ids[2] and ids[3] < ids[2] and ids[4] == ids[3]
    assert cut.where("n_chars <> length(text)").count() == 0


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert [d.count() for d in through(spark, docs, sf)] == [0] * 5


def brute_run(docs, languages, sf_tokenizer):
    """(doc_id, piece, start, length, ids_crc32) of every row, and the ids whose draw is too close
    to call.  ``docs``: (id, text, lang, source); ``languages``: id -> whether the model keeps it."""
    docs = sorted(d for d in docs if languages[d[0]])
    prints = np.array([brute_fingerprint(t) for _, t, _, _ in docs], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    root = spanning_labels(len(docs), *np.nonzero(near))
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    first, texts = {}, {}
    for d, t, _, _ in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = True
        texts[d] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    cells, cell_of = Counter(), {}
    for d, _, lang, source in docs:
        topic = next((n for n, p in mixing.TOPIC_CUES if re.search(p, texts[d])), mixing.GENERAL)
        cell_of[d] = (source or mixing.MISSING, lang or mixing.MISSING, topic)
        cells[cell_of[d]] += max(1, len([w for w in re.split(r"[\x20\x09-\x0D]+", texts[d]) if w]))
    weight = brute_rake(dict(cells), MIX)
    rows, close = [], set()
    tokenizer = Tokenizer.from_file(sf_tokenizer)
    for d, cell in cell_of.items():
        unit = int(hashlib.md5(f"{MIX.seed}:{d}".encode()).hexdigest()[:12], 16) / 2**48
        chance = min(1.0, weight[cell] / cells[cell])
        if abs(unit - chance) < 0.01:
            close.add(d)
        elif unit < chance:
            ids = [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0]
            for piece, (start, length) in enumerate(packing.cut_lengths(len(ids), 2048)):
                crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                rows.append((d, piece, start, length, crc))
    return sorted(rows), close


def test_run_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs.where("text is not null").orderBy("doc_id").limit(60).collect()
    near = held[1].text.replace(" ", "  ", 3)
    shared = held[2].text[:400]
    more = [
        (10**6, near, "en", "s", 1),
        (10**6 + 1, f"quite other words come before {shared} and after it", "en", "s", 1),
        (10**6 + 2, "12345 !!", "en", "s", 1),
        (10**6 + 3, None, "en", "s", 1),
    ]
    rows = [tuple(r) for r in held] + more
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    path = str(tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert len(kept) == len(rows) - 2 and not kept & {10**6 + 2, 10**6 + 3}
    want, close = brute_run([(r[0], r[1], r[2], r[3]) for r in rows if r[1] is not None], {r[0]: r[0] in kept for r in rows}, tokenizer_file("byte_bpe_50k.json"))
    got = pipeline.run(spark, path).collect()
    found = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id not in close)
    assert found == want and len(close) < 10
    assert 10**6 not in {r.doc_id for r in got}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 2048
