"""SimHash, repeated passages, quality rules, licences and language ID against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from valuelab.llm import langid, licenses, quality, simhash, suffixes
from valuelab.llm.common import components, spanning_labels

SCHEMA = "doc_id long, text string, lang string, source string, count long, id string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", "s", 1, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts(seed=3):
    r = random.Random(seed)
    words = ["the", "Über", "ß", "a", "of", "naïve", "x1", "###", "|", "lorem", "ipsum", "dolor"]
    out = [None, "", " \t\n", "one", "one two", "one two three", "ONE  two\tthree", "日本 語"]
    out += [" ".join(r.choices(words, k=r.randint(3, 120))) for _ in range(60)]
    out += [t + " tail" for t in out[-10:]] + out[-5:]
    out.append(" ".join(r.choices(words, k=30_000)))
    return out


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash_against_brute_force(spark, tile):
    texts = odd_texts()
    base = random.Random(1)
    # near copies: long texts with one word changed, so that fingerprints differ in few bits
    words = [f"w{base.randint(0, 500)}" for _ in range(400)]
    for k in range(12):
        changed = list(words)
        changed[base.randint(0, 399)] = f"v{k}"
        texts.append(" ".join(changed))
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts), tile=tile).collect()}
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    labels = spanning_labels(len(fps), *np.nonzero(near))
    assert len(got) == len(texts)
    for i, fp in enumerate(fps):
        assert got[i].fingerprint == f"{int(fp):016x}"
        assert got[i].component_id == labels[i]


def test_simhash_keys_miss_no_pair():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**64, 300, np.uint64)
    for _ in range(3):
        a = np.concatenate([a, a[:300] ^ (np.uint64(1) << r.integers(0, 64, 300, np.uint64))])
    masks = [simhash.MASKS[i] | simhash.MASKS[(i + s) % 5] for i in range(5) for s in (1, 2)]
    for flips in range(4):
        for _ in range(500):
            bits = r.choice(64, flips, replace=False)
            x = sum(1 << int(b) for b in bits)
            assert any(x & m == 0 for m in masks)


def test_simhash_nulls_repeats_and_empty(spark):
    docs = frame(spark, ["a b c", "a b c", None, "", "a b c"], [7, 7, 3, None, 9])
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == 5
    assert {r.component_id for r in rows if r.doc_id in (7, 9)} == {7}
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in simhash.drop_near_copies(docs).collect()) == [-1, 3, 7, 7]
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_kept_documents_have_their_own_columns(spark):
    rows = [(1, "same words here", 5, "a"), (2, "same words here", 6, "b"), (None, "x", 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, row string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in kept.collect()) == [(5, "a"), (7, "c")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100 + k: 100 for k in range(50)}


def brute_cut(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [250_000, 2])
def test_repeated_passages_against_brute_force(spark, hot):
    r = random.Random(5)
    letters = "abcé ß日\n"
    block = lambda n: "".join(r.choices(letters, k=n))
    shared = [block(49), block(50), block(51), block(120), "a" * 200, "ab" * 90]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, *shared]
    for _ in range(60):
        parts = [block(r.randint(0, 40)) if r.random() < 0.5 else r.choice(shared) for _ in range(r.randint(1, 6))]
        texts.append("".join(parts))
    texts += texts[10:14] + [block(70_000) + shared[3]]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = frame(spark, [texts[i] for i in order], order)
    got = {
        x.id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)
        for x in suffixes.remove_repeats(docs, hot=hot).collect()
    }
    assert got == brute_cut([(i, texts[i]) for i in order])


def test_repeated_passages_odd_rows(spark):
    long_ = "".join(random.Random(8).choices("abcdefgh ", k=300))
    docs = frame(spark, [long_, long_, long_, None, long_ + "é"], [4, 4, None, 1, 2])
    rows = suffixes.remove_repeats(docs).collect()
    by = Counter((r.id, r.n_removed) for r in rows)
    # id 2 is least and keeps; both rows with id 4 lose all to it; the null id neither takes nor loses
    assert by == {(2, 0): 1, (4, 300): 2, (None, 0): 1, (1, 0): 1}
    assert next(r for r in rows if r.id == 1).text is None
    assert next(r for r in rows if r.id == 2).text == long_ + "é"
    assert rows[0].rest["count"] == 1 and rows[0].rest.id == "x"
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [250_000, 1])
def test_texts_under_one_id_lose_their_own_bytes(spark, hot):
    r = random.Random(3)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, other = text(80), text(80)
    rows = [(1, passage), (5, text(60) + passage + text(30)), (5, text(200)), (5, other), (6, other + text(9)), (6, text(90))]
    rows += [(5, rows[1][1]), (7, rows[2][1])]
    want = Counter()
    for d, t in rows:
        gone = brute_cut([x for x in rows if x[0] < d] + [(d, t)])[d]
        want[(d, *gone)] += 1
    got = suffixes.remove_repeats(frame(spark, [t for _, t in rows], [d for d, _ in rows]), hot=hot).collect()
    assert Counter((x.id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert sum(x.n_removed > 0 for x in got) == 4


def brute_quality(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(s) for s in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_counts_against_brute_force(spark):
    texts = odd_texts(9) + ["a b c a b c", "x\nx\n\n \nx", "a b c", "😀 #b" * 30, "b a " * 40]
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(frame(spark, ["x"]).limit(0)).count() == 0


def test_quality_plan_has_no_shuffle_and_no_python(spark):
    plan = quality.judge(frame(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_licences(spark):
    texts = [
        None,
        "",
        "Plain words only.",
        "# Licensed under the Apache License, Version 2.0.\n# You may not use this file except in "
        "compliance with the License.\n# You may obtain a copy of the License at\n#   http://www.apache.org/licenses/LICENSE-2.0",
        "Some text. Released under the MIT License. More text.",
        "This work is licensed under the GNU General Public License, version 3.\n"
        "Either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        "A licence that nobody knows.",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    names = [got[i].licenses for i in range(len(texts))]
    assert names == ["", "", "", "Apache-2.0", "MIT", "GPL-3.0-or-later", "GPL-3.0-only", "MIT+CC-BY-NC", ""]
    assert got[8].n_sentences == 0 or got[8].n_unknown == got[8].n_sentences
    assert licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0
    plan = licenses.scan_licenses(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation."""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software."""
GNU = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation; {}version {} of the License{}.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {} for more details."""


def gnu(kind, version, later=True):
    return GNU.format(kind, "either " if later else "", version, ", or\n(at your option) any later version" if later else "", kind)


WRAPPED = [
    ("Apache-2.0", APACHE),
    ("MIT", MIT),
    ("BSD-2-Clause", BSD2),
    ("BSD-3-Clause", BSD3),
    ("GPL-2.0-or-later", gnu("General Public License", "2")),
    ("GPL-3.0-or-later", gnu("General Public License", "3").replace("software;", "software:")),
    ("GPL-2.0-only", gnu("General Public License", "2", later=False)),
    ("GPL-3.0-only", gnu("General Public License", "3", later=False)),
    ("LGPL-2.1-or-later", gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", gnu("Lesser General Public License", "3")),
    ("AGPL-3.0-or-later", gnu("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-SA", "This work is licensed under a Creative Commons Attribution-\nNonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY", "This work is licensed under the Creative Commons\nAttribution 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work."),
    ("PublicDomain", "This is free and unencumbered software released into the\npublic domain."),
    ("Proprietary", "Copyright (c) 2020 Some Body\nAll rights\nreserved."),
]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "; "])
def test_wrapped_licence_notices(spark, mark):
    texts = ["Some Heading\n" + "".join(f"{mark}{line}".rstrip() + "\n" for line in t.split("\n")) + "code()\n" for _, t in WRAPPED]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].licenses for i in range(len(texts))] == [name for name, _ in WRAPPED]
    assert got[0].identifiers == ",ApacheGrant,,ApacheComply,,ApacheUrl,,ApacheAsIs,,ApacheSee," and got[0].n_unmatched == 0


def test_a_second_licence_on_the_next_line(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand its files"
    texts = [
        f"{mit}\nThis work is licensed under CC BY 4.0",
        f"# {mit}\n# Licensed under the MIT license\n# Licensed under a CC BY-SA 4.0",
        f"This file is\nlicensed under the Apache License, Version 2.0\n{mit}",
    ]
    rows = licenses.scan_licenses(frame(spark, texts, [0, 1, 2])).orderBy("doc_id").collect()
    assert [set(r.licenses.split("+")) for r in rows] == [{"MIT", "CC-BY"}, {"MIT", "CC-BY-SA"}, {"Apache-2.0", "MIT"}]


def test_spdx_lines_and_lines_without_stops(spark):
    texts = [
        "// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\nint x;",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx = 1",
        "/* SPDX-License-Identifier: BSD-3-Clause */",
        "Licensed under CC BY-NC 4.0\nReleased under the MIT License\nmore",
        "Our licence is a\nlicense that no one\nknows.",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].licenses for i in range(5)] == ["GPL-2.0-only", "Apache-2.0+MIT", "BSD-3-Clause", "MIT+CC-BY-NC", ""]
    assert (got[4].n_sentences, got[4].n_unknown) == (1, 1)


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !!", None), (None, "the of and", "en"), (-4, "é", None)],
        docs.schema,
    )
    model = langid.fit_documents(docs.unionByName(odd))
    rows = {r.doc_id: r for r in langid.predict(odd.withColumn("score", F.lit("x")), model).collect()}
    assert [rows[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and rows[-1].score == 0
    assert rows[None].lang_pred in model.languages and rows[-4].lang_pred in model.languages
    empty = langid.identify(odd.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]


def brute_model(sample, frequency, n, settings):
    """Coefficients (idf taken in) and temperature, one feature and one language at a time."""
    fold = langid.letter_table()
    languages = sorted({language for _, language in sample})
    order = np.random.default_rng(settings.seed).permutation(len(sample)).tolist()
    cut = int(len(order) * settings.sample / (settings.sample + settings.calibration))
    idf = {f: math.log((1 + n) / (1 + frequency[f])) + 1 for f in range(len(frequency))}
    rows = []
    for i in order:
        found = [int(f) for part in langid.features(sample[i][0].decode(), fold, settings) for f in part]
        rows.append(({f: c / len(found) * idf[f] * langid.SCALE for f, c in Counter(found).items()}, sample[i][1]))
    z, g = Counter(), Counter()

    def weight(f, y):
        if abs(z[f, y]) <= settings.l1:
            return 0.0
        shrunk = z[f, y] - math.copysign(settings.l1, z[f, y])
        return -shrunk / ((settings.beta + math.sqrt(g[f, y])) / settings.alpha + settings.l2)

    def chances(x, t=1.0):
        scores = {y: sum(v * weight(f, y) for f, v in x.items()) / t for y in languages}
        top = max(scores.values())
        total = sum(math.exp(s - top) for s in scores.values())
        return {y: math.exp(s - top) / total for y, s in scores.items()}

    for _ in range(settings.epochs):
        for x, label in rows[:cut]:
            p = chances(x)
            steps = []
            for f, v in x.items():
                for y in languages:
                    slope = v * (p[y] - (y == label))
                    rate = (math.sqrt(g[f, y] + slope**2) - math.sqrt(g[f, y])) / settings.alpha
                    steps.append((f, y, slope - rate * weight(f, y), slope**2))
            for f, y, dz, dg in steps:
                z[f, y] += dz
                g[f, y] += dg
    grid = [math.exp(math.log(0.05) + i * (math.log(20) - math.log(0.05)) / 120) for i in range(121)]
    loss = [-sum(math.log(chances(x, t)[label]) for x, label in rows[cut:]) for t in grid]
    weights = [[weight(f, y) * idf[f] * langid.SCALE for y in languages] for f in range(len(frequency))]
    return languages, np.array(weights), grid[int(np.argmin(loss))]


def test_ftrl_and_temperature_against_brute_force(spark, sf):
    settings = langid.Settings(bits=8, sample=30, calibration=12, epochs=2, l1=0.05)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and lang is not null")
    rows = docs.where("length(text) < 900").select("text", "lang")
    copies = rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n")
    rows = rows.unionByName(copies)  # one text three hundred times more
    sample = langid._sample(rows, settings)
    assert len(sample) == len({t for t, _ in sample}) <= 42
    model = langid.train(rows, settings)
    frequency, n = langid.document_frequencies(rows.select("text"), settings)
    fold = langid.letter_table()
    texts = [r.text for r in rows.collect()]
    seen = Counter(f for t in texts for f in {int(f) for part in langid.features(t, fold, settings) for f in part})
    assert n == len(texts) and all(seen[f] == c for f, c in enumerate(frequency.tolist()))
    languages, weights, temperature = brute_model(sample, frequency.tolist(), n, settings)
    assert model.languages == languages and abs(model.temperature / temperature - 1) < 1e-9
    assert np.allclose(model.weights, weights, rtol=1e-6, atol=1e-9)
    assert (weights == 0).any() and (weights != 0).any()
