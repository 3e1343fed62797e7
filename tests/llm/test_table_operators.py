"""Cap filters, packing, token files, shards and mixing against brute force or a round trip."""

import glob
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valuelab.llm import capfilters, mixing, orcids, packing, shuffling
from valuelab.llm.common import spanning_labels, staged
from valuelab.llm.tokens import ByteEncoder, WordEncoder
from valuelab.sources import work_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark, seed=2, n=300, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, dim))
    near = base[: n // 3] + 0.12 * r.normal(size=(n // 3, dim)) * np.linalg.norm(base, axis=1, keepdims=True) / 4
    all_ = np.concatenate([base, near, base[:20], base[:20] * 3]).astype(np.float32)
    labels = r.integers(0, 3, len(all_))
    labels[len(base) : 2 * len(base)] = labels[: len(base)]
    rows = [(i, [float(x) for x in v], int(l), "x") for i, (v, l) in enumerate(zip(all_, labels))]
    odd = [
        (900, None, 1, "x"),
        (901, [0.0] * dim, 1, "x"),
        (902, [float("nan")] * dim, 1, "x"),
        (903, [None] + [1.0] * (dim - 1), 1, "x"),
        (904, rows[0][1], None, "x"),
        (905, [float("inf")] + [1.0] * (dim - 1), 1, "x"),
        (906, [1.0, 2.0], 1, "x"),
        (907, [1.0, 2.0], 1, "x"),
    ]
    return rows, odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n string")


def brute_links(rows, least=0.98):
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, True)
    root = spanning_labels(len(rows), *np.nonzero(near))
    return {rows[i][0]: (int(near[i].sum()) - 1, rows[root[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("tile", [1024, 3])
def test_cap_filters_against_brute_force(spark, tile):
    rows, odd, df = vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.link_vectors(df, tile=tile).collect()}
    want = brute_links(rows) | {r[0]: (0, r[0]) for r in odd[:6]} | {906: (1, 906), 907: (1, 906)}
    assert got == want
    assert capfilters.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 6, 8, 16, 64])
def test_cap_filters_of_any_length(spark, dim):
    """All links that brute force finds, over pairs just above the threshold."""
    r = np.random.default_rng(dim)
    a = r.normal(size=(150, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-9)
    b = 0.985 * a + np.sqrt(1 - 0.985**2) * o
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))]
    want = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in capfilters.link_vectors(df).collect()}
    found, all_ = (sum(v[0] for v in x.values()) for x in (got, want))
    assert all_ > 0 and 0.99 * all_ <= found <= all_
    if dim <= 4:
        assert got == want


def test_cap_filters_of_many_lengths_and_null_ids(spark):
    r = np.random.default_rng(4)
    rows = []
    for d in range(1, 131):
        v = r.normal(size=d)
        rows += [(2 * d, v.tolist(), 1), (2 * d + 1, (v + 0.001).tolist() if d > 1 else v.tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in capfilters.link_vectors(df).collect()}
    assert got == {i: (1, i - i % 2) for i, _, _ in rows}
    # two classes, each with vectors whose ids are null, stay apart; one class has no id at all
    axis = lambda i, e: [1.0 * (k == i) + e * (k == 5) for k in range(6)]
    ids = [(10, 0, 0.0), (None, 0, 0.1), (20, 1, 0.0), (None, 1, 0.1), (None, 2, 0.0), (None, 2, 0.1), (30, 3, 0.0)]
    df = spark.createDataFrame([(i, axis(k, e), 1) for i, k, e in ids], df.schema)
    got = sorted(((x.vec_id or 0, x.n_links, x.component_id or 0) for x in capfilters.link_vectors(df).collect()))
    assert got == sorted([(10, 1, 10), (0, 1, 10), (20, 1, 20), (0, 1, 20), (0, 1, 0), (0, 1, 0), (30, 0, 30)])


def test_cap_filter_recall_at_the_threshold():
    r = np.random.default_rng(1)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    met = np.zeros(len(a), bool)
    for rotation, books, least in capfilters.codebooks(64, capfilters.Code()):
        sets = [defaultdict(set) for _ in range(2)]
        for side, x in zip(sets, (a, b)):
            for row, f in zip(*capfilters.list_decode(x @ rotation, books, least)):
                side[row].add(f)
        met |= np.array([bool(sets[0][i] & sets[1][i]) for i in range(len(a))])
    assert met.mean() >= 0.99


def fuzz(n=600, seed=4):
    r = random.Random(seed)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", " 12", ".", "!?", "日本", "\x1c", "<|endoftext|>", "Σ", "ß", "́", "\x85", "　", "H̱"]
    return ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(n)]


def test_encoders_equal_the_library():
    texts = fuzz()
    byte, word = ByteEncoder(BYTES), WordEncoder(WORDS, most=50)
    for text in texts:
        assert byte.encode(text).tolist() == byte.tokenizer.encode(text, add_special_tokens=False).ids
    for text, ids in zip(texts, word.encode_all(texts)):
        assert ids.tolist() == word.encode(text)


def docs_frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame(
        [(i, t, "r") for i, t in zip(ids, texts)], "doc_id long, text string, row string"
    )


@pytest.mark.parametrize("blank", [" ", "\n", "\t "])
def test_long_runs_of_blanks(spark, blank):
    text = f"a{blank * (2_000_000 // len(blank))}b"
    tokenizer = Tokenizer.from_file(BYTES)
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ByteEncoder(BYTES).encode(text).tolist() == want
    if blank == " ":
        rows = packing.pack_documents(docs_frame(spark, [text, "plain"]), BYTES).collect()
        assert sum(r.length for r in rows if r.doc_id == 0) == len(want) + 1 and {r.doc_id for r in rows} == {0, 1}


def test_packing_of_several_groups_near_the_bound(spark):
    r = random.Random(2)
    texts = [" ".join("word" for _ in range(r.randrange(1, 400))) for _ in range(3000)]
    rows = packing.pack_documents(docs_frame(spark, texts), BYTES, group=700).collect()
    total = sum(x.length for x in rows)
    assert len({x.sequence_id for x in rows}) <= 1.02 * (total / 2048) + 2 * 5


def test_packing_keeps_every_id(spark):
    texts = [None, "", "word", "many words " * 3000, *fuzz(80), "same", "same"]
    ids = [*range(len(texts) - 2), 5, 5]
    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter()
    for d, t in zip(ids, texts):
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (start, length) in enumerate(packing.cut_lengths(len(own), 2048)):
            part = np.array(own[start : start + length], "<u4").tobytes()
            want[d, k, start, length, zlib.crc32(part)] += 1
    rows = packing.pack_documents(docs_frame(spark, texts, ids), BYTES, group=40).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs_frame(spark, ["x"]).limit(0), BYTES).count() == 0
    with_ids = packing.pack_documents(docs_frame(spark, ["a b c"]), BYTES, with_ids=True).first()
    assert list(with_ids.ids) == tokenizer.encode("a b c").ids + [0]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_holds_every_capacity(score):
    r = np.random.default_rng(3)
    lengths = r.integers(1, 60, 2000)
    room = packing.Capacity(64, documents=5, attention=2500 + 1100, score=score, weights=(1, 0.2, 0.2))
    sequence, offset = packing.best_fit(lengths, room)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 64 and len(own) <= 5 and (own**2).sum() <= 3600
    plain, _ = packing.best_fit(lengths, packing.Capacity(64, score=score))
    assert len(np.unique(plain)) <= 1.02 * np.ceil(lengths.sum() / 64) + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([70]), packing.Capacity(64))


def test_orc_round_trip(spark):
    texts = [None, "", "One two", *fuzz(50), "long words " * 5000, "b", "a"]
    ids = [*range(len(texts) - 2), 3, 3]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    path = work_folder(spark)
    orcids.write_ids(docs_frame(spark, [texts[i] for i in order], [ids[i] for i in order]), path, WORDS)
    back = orcids.read_ids(spark, path)
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter(
        (d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in zip(ids, texts)
    )
    assert Counter((r.doc_id, tuple(r.ids)) for r in back.collect()) == want
    rows = sorted(orcids.digest(back).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert back.where("doc_id = 3").count() == 3
    import pyarrow.orc as orc

    file = next(os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".orc"))
    assert orc.ORCFile(file).row_index_stride == 1000
    empty = work_folder(spark)
    orcids.write_ids(docs_frame(spark, ["x"]).limit(0), empty, WORDS)
    assert orcids.digest(orcids.read_ids(spark, empty)).count() == 0


def test_external_shuffle(spark):
    texts = [None, "", "é", *[f"t{i}" for i in range(997)], "same", "same"]
    ids = [*range(1000), 7, None]
    docs = docs_frame(spark, texts, ids)
    rows = shuffling.shuffle_to_shards(docs, shards=7, bucket_rows=50).collect()
    size = Counter(r.shard for r in rows)
    assert len(rows) == 1002 and len(size) == 7 and max(size.values()) - min(size.values()) <= 1
    for k in size:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(size[k]))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in zip(ids, texts))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    # neighbours in the input are spread, and slots say nothing about ids
    first = [r for r in rows if r.doc_id is not None and r.doc_id < 100]
    assert len({r.shard for r in first}) == 7
    assert abs(np.corrcoef([r.doc_id or 0 for r in rows], [r.shard for r in rows])[0, 1]) < 0.15
    assert shuffling.shuffle_to_shards(docs.limit(0)).count() == 0
    few = shuffling.shuffle_to_shards(docs.limit(3), shards=40).collect()
    assert len(few) == 3 and max(Counter(r.shard for r in few).values()) == 1
    path = shuffling.write_shards(docs, shards=4, bucket_bytes=4000)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(zip(ids, texts))


def test_shards_of_records_with_clashing_and_map_columns(spark):
    """Columns named like the operator's own, a map column, and one row a thousand times over."""
    rows = [(i, f"t{i}", i, f"s{i}", i * 2, {"k": i}, None) for i in range(200)] + [(7, "same", 1, "s", 2, {}, "r")] * 1000
    names = "doc_id long, text string, bucket int, Shard string, slot int, part map<string,int>, row string"
    docs = spark.createDataFrame(rows, names)
    path = shuffling.write_shards(docs, shards=6, bucket_rows=100)
    back = shuffling.read_shards(docs, path)
    assert back.columns == [*docs.columns, "slot_", "shard_"]
    key = lambda r: repr(tuple(r)[:7])
    got = back.collect()
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))
    size = Counter(r.shard_ for r in got)
    assert sorted(size.values()) == [200] * 6
    alike = Counter(r.shard_ for r in got if r.text == "same")
    assert len(alike) == 6 and max(alike.values()) < 190
    again = shuffling.shuffle_to_shards(docs, shards=6, bucket_rows=100).collect()
    assert {(r.shard, r.slot) for r in again} == {(s, i) for s in range(6) for i in range(200)}


def test_digest_is_of_the_written_records(spark, tmp_path):
    texts = [None, "", *[f"t{i}" for i in range(500)], "same", "same"]
    ids = [*range(502), 3, None]
    docs = docs_frame(spark, texts, ids)
    path = str(tmp_path / "shards")
    rows = shuffling.shuffle_to_shards(docs, shards=5, bucket_rows=40, path=path).collect()
    found = []
    for name in glob.glob(f"{path}/shard=*/*.parquet"):
        held = pq.ParquetFile(name).read()
        slots = held["slot"].to_pylist()
        assert slots == sorted(slots) and set(docs.columns) < set(held.column_names)
        shard = int(name.split("shard=")[1].split("/")[0])
        for i, text, slot in zip(held["doc_id"].to_pylist(), held["text"].to_pylist(), slots):
            data = (text or "").encode()
            found.append((i, len(data) + 16, zlib.crc32(data), shard, slot))
    assert Counter(found) == Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert len(found) == len(ids)


def mixed(spark, seed=6):
    r = random.Random(seed)
    rows = []
    for i in range(1500):
        source = "hot" if r.random() < 0.4 else r.choice(["a", "b", None])
        text = r.choice(["plain words here", "a licence text", "x | y | z | w", "mail me@example.org now", "", None])
        rows.append((i, text, source, r.choice(["en", "fr", None]), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")


def brute_rake(cells, targets, sweeps=200):
    weight = {c: t * targets.fraction for c, t in cells.items()}
    total = sum(cells.values())
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        values = sorted({c[d] for c in cells})
        wanted = targets.shares.get(name, {v: 1.0 for v in values})
        listed = {v: wanted[v] for v in values if v in wanted}
        others = [v for v in values if v not in wanted]
        rest = 0 if not others else (1.0 if not listed else targets.rest)
        goal = {v: (1 - rest) * s / sum(listed.values()) for v, s in listed.items()}
        goal |= {v: rest / len(others) for v in others}
        goals.append({v: g * total * targets.fraction for v, g in goal.items()})
    for _ in range(sweeps):
        for d in range(3):
            sums = Counter()
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: min(cells[c], w * goals[d][c[d]] / sums[c[d]]) for c, w in weight.items()}
    return weight


@pytest.mark.parametrize("per_task", [100_000, 5])
def test_raking_against_brute_force(spark, per_task):
    docs = mixed(spark)
    targets = mixing.Targets(shares={"lang": {"en": 0.5, "fr": 0.4, "xx": 0.3}}, fraction=0.3, sweeps=60, tolerance=1e-9)
    cells = mixing.weighed(docs).groupBy(*mixing.DIMENSIONS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, targets, per_task).collect()}
    held = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}
    want = brute_rake(held, targets)
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) <= 1e-3 * sum(held.values()) for c in want)


def test_sweeps_of_a_job_stop_like_single_sweeps(spark):
    cells = mixing.weighed(mixed(spark)).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")).persist()
    for tolerance in (1e-2, 1e-4):
        targets = mixing.Targets(shares={"lang": {"en": 0.7, "fr": 0.2}}, fraction=0.3, sweeps=7, tolerance=tolerance)
        ways = ({"sweeps_per_job": 1}, {"sweeps_per_job": 5}, {"cells_per_task": 5})
        got = [
            {(r.source, r.lang, r.topic): (r.weight, r.gap) for r in mixing.rake(cells, targets, **way).collect()}
            for way in ways
        ]
        assert len(got[0]) == cells.count() and all(g.keys() == got[0].keys() for g in got)
        assert all(g[c] == pytest.approx(got[0][c], rel=1e-9, abs=1e-12) for g in got for c in g)
    cells.unpersist()


def test_raking_needs_few_tasks(spark):
    """Each task and job is kept in the driver's memory; sweeps over few cells must not add up."""
    rows = [(f"s{i % 5}", f"l{i % 3}", f"t{i % 2}", 100 + i) for i in range(30)]
    cells = staged(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").repartition(20))
    targets = mixing.Targets(sweeps=40, tolerance=-1.0)  # never settled
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        context.setJobGroup("raking", "raking")
        assert mixing.rake(cells, targets).count() == 30
    finally:
        context._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = context.statusTracker()
    jobs = tracker.getJobIdsForGroup("raking")
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert len(jobs) <= 60 and sum(s.numTasks for s in stages if s) <= 300


def test_mix_follows_probabilities(spark):
    docs = mixed(spark)
    rows = mixing.mix(docs, mixing.Targets(fraction=0.4)).collect()
    assert len(rows) == 1500 and all(0 <= r.probability <= 1 for r in rows)
    expected = sum(r.tokens * r.probability for r in rows)
    kept = sum(r.tokens for r in rows if r.kept)
    assert abs(kept - expected) < 0.1 * expected
    sampled = mixing.sample_mix(docs, mixing.Targets(fraction=0.4))
    assert sampled.columns == docs.columns
    assert {r.doc_id for r in sampled.collect()} == {r.doc_id for r in rows if r.kept}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.sample_mix(docs.limit(0)).count() == 0


def test_mix_runs_no_python(spark):
    plan = mixing.mix(mixed(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_returns_the_callers_columns(spark):
    rows = [(i, f"text {i}", "en", "s", "mine", "t", i, {"k": i}) for i in range(50)]
    names = "doc_id long, text string, lang string, source string, _source string, topic string, unit int, row map<string,int>"
    docs = spark.createDataFrame(rows, names)
    kept = mixing.sample_mix(docs, mixing.Targets(fraction=0.5), topic_col="topic")
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert 5 < len(got) < 45 and all(r in rows for r in got)
    told = mixing.mix(docs, mixing.Targets(fraction=0.5), topic_col="topic").collect()
    assert {r.topic for r in told} == {"t"} and {r.doc_id for r in told if r.kept} == {r[0] for r in got}
