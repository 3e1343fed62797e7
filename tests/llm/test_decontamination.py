"""Benchmark windows against brute force, odd rows, and the cut texts."""

import hashlib
import random
import re

import pytest

from valuelab.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text or ""))
        size = min(len(words), 10)
        for i in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        words = WORD.findall(lowered(text or ""))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(ids), digest, len(hit) > 0))
    return sorted(out, key=repr)


def sample(seed=5):
    r = random.Random(seed)
    vocabulary = ["Été", "été", "a1", "bb", "C", "d-e", "ß", "ÀB", "x" * 40, "中文", "no", "yes"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 10, 11, 25, 40]))) for i in range(25)]
    items += [(100, items[0][1]), (101, "..."), (102, None), (None, text(12)), (103, "")]
    docs = []
    for i in range(120):
        parts = [text(r.randrange(0, 40))]
        for _ in range(r.randrange(3)):
            words = (r.choice(items)[1] or "").split()
            low = r.randrange(max(1, len(words) - 5))
            parts += [" ".join(words[low : low + r.randrange(1, 30)]).upper(), text(r.randrange(9))]
        docs.append((i, ", ".join(parts)))
    docs += [(5, docs[7][1]), (5, docs[5][1]), (None, docs[3][1]), (None, None), (200, None), (201, ""), (202, "!?\n")]
    return docs, items


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_windows_against_brute_force(spark, most):
    docs, items = sample()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in leaks.report(d, b, broadcast_bytes=most).collect()), key=repr)
    assert got == brute(docs, items)
    long_only = [i for i in items if len((i[1] or "").split()) >= 10]
    b = spark.createDataFrame(long_only, "item_id long, text string")
    assert sorted((tuple(r) for r in leaks.report(d, b).collect()), key=repr) == brute(docs, long_only)


def test_empty_tables(spark):
    docs, items = sample()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert leaks.report(d.limit(0), b).count() == 0
    none = leaks.report(d, b.where("item_id in (101, 102)")).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_texts_lose_the_hit_words(spark):
    """Extra columns with the operator's inner names come back as they were."""
    passage = "one two Three four five six seven eight nine ten eleven"
    rows = [
        (1, f"(Before) {passage}, after.", "a", 7, "s", [1]),
        (2, "nothing here", "b", 8, None, None),
        (3, passage, "c", 9, "t", []),
        (1, "the same id, clean", "d", 7, "u", [2]),
        (None, None, "e", 7, "v", [3]),
        (4, f"{passage}!", None, 1, "w", [4]),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, row string, id long, digest string, spans array<int>")
    b = spark.createDataFrame([("q", passage)], "item_id string, text string")
    cut = leaks.decontaminate(d, b)
    assert cut.columns == d.columns
    want = {"a": "(Before) after.", "b": "nothing here", "c": "", "d": "the same id, clean", "e": None, None: ""}
    got = cut.collect()
    assert {r["row"]: r.text for r in got} == want and len(got) == 6
    assert sorted((r["id"], r["digest"] or "", r["spans"] or []) for r in got) == sorted(
        (r[3], r[4] or "", r[5] or []) for r in rows
    )
    kept = leaks.decontaminate(d, b, remove="documents").collect()
    assert {r["row"] for r in kept} == {"b", "d", "e"}
    assert {r["row"] for r in leaks.decontaminate(d, b, most_share=0.95).collect()} == {"a", "b", "d", "e"}


def test_long_text_and_plan(spark):
    rows = [(1, "w " * 300_000 + " ".join(f"k{i}" for i in range(10)) + " v" * 300_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(10)))], "item_id long, text string")
    out = leaks.report(d, b)
    r = out.first()
    assert (r.n_words, r.n_hit, r.n_items) == (600_010, 10, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "InArrow" not in plan
