"""Spelling variants against brute force; the scan against whole edit matrices."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from valuelab.llm import variants

LETTERS = "abcxyzéïÿ"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def near_form(count):
    """word -> (form, root, n, n_near, form_n) by comparing all pairs."""
    best, near = {}, Counter()
    for a in count:
        found = [b for b in count if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1]
        near[a] = len(found)
        if found:
            top = min(found, key=lambda b: (-count[b], b))
            if count[top] >= 2 * count[a]:
                best[a] = top

    def root(w):
        return root(best[w]) if w in best else w

    return {w: (best.get(w), root(w), n, near[w], count.get(best.get(w))) for w, n in count.items()}


def brute(docs, least=5, count=3, one_in=97):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return near_form({w: n for w, n in found.items() if len(w) >= least and n >= count})


def table(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def words(seed, n, low=1, high=9):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(r.choice(LETTERS) for _ in range(r.randint(low, high)))
        out.add(w)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w) + 1)
            out.add(r.choice([w[:i] + r.choice(LETTERS) + w[i:], w[: i - 1] + w[i:] or "q", w[:i] + "z" + w[i + 1 :]]))
    return sorted(out)


@pytest.mark.parametrize("long_list", [10_000, 8, 1])
def test_all_near_words_count_once(spark, long_list):
    r = random.Random(1)
    count = {w: r.randint(1, 60) for w in words(4, 500)}
    vocab = spark.createDataFrame(list(count.items()), "word string, n long")
    got = variants.spelling_variants(vocab, long_list=long_list).collect()
    assert table(got) == near_form(count) and len(got) == len(count)


def test_scan_against_whole_matrices(monkeypatch):
    monkeypatch.setattr(variants, "PAIRS", 50)
    for short in (1, 2, 5):
        lists, rows = [], []
        for number in range(4):
            own = sorted(w for w in words(number + 10 * short, 120, short, short + 1) if len(w) in (short, short + 1))
            rows += own
            lists += [number * 7] * len(own)
        size = np.array([len(w) for w in rows])
        letters = np.array([list(w.encode("latin-1").ljust(short + 2, b"\0")) for w in rows], np.uint8)
        got = set(zip(*(x.tolist() for x in variants.scan(letters, size, np.array(lists), short))))
        want = {
            (i, j)
            for i, a in enumerate(rows)
            for j, b in enumerate(rows)
            if len(a) == short and lists[i] == lists[j] and edits(a, b) == 1
        }
        assert got == want and want


def sample():
    r = random.Random(9)
    vocabulary = words(3, 60, 4, 8)
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = []
    for i in range(150):
        text = " ".join(r.choices(vocabulary, weights, k=r.randrange(60)))
        docs.append((i, r.choice([text, text.title(), text.upper(), text.replace(" ", "1, ")])))
    docs += [(3, docs[5][1]), (3, docs[5][1]), (None, docs[6][1]), (None, None), (900, ""), (901, "a" * 5000 + " 中文" * 3)]
    return docs + [(902, "a" * 5000), (903, "a" * 5000 + "!" + "b" * 4999)]


def test_variants_of_texts_against_brute_force(spark):
    docs = sample()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, list int")
    for one_in in (97, 5):
        got = variants.group_variants(df.repartition(3), one_in=one_in).collect()
        assert table(got) == brute(docs, one_in=one_in)
    assert any(r.form for r in got)


def test_chains_reach_their_end(spark):
    count = {"aaaaa"[:5] + "b" * i: 2**i for i in range(9)}
    got = variants.spelling_variants(spark.createDataFrame(list(count.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"aaaaa" + "b" * 8}


def test_empty(spark):
    df = spark.createDataFrame(sample(), "doc_id long, text string")
    got = variants.group_variants(df.limit(0))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
