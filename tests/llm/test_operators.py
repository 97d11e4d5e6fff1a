"""The ten operators against brute force, exact round trips, held-out accuracy, and edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat, html_text, jaccard, language, licenses, media, mixing, packing, quality, shared, urls

SMALLEST = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra string"
#: Nulls in every column, an empty and a very long text, ties, repeated rows, an extra column that clashes with results.
ODD = [
    (1, None, "en", "a", "x"), (None, "some words of a text without an id here", None, None, None), (2, "", "en", "a", "x"), (3, " \n\t ", None, "b", "x"),
    (4, "word " * 30000, "en", "a", "x"), (5, "one two three four five six seven eight nine ten eleven twelve", "en", None, "x"),
    (5, "one two three four five six seven eight nine ten eleven twelve", "en", None, "x"), (6, "one two three four five six seven eight nine ten eleven twelve", "de", "b", "x"),
    (7, "x", "fr", "b", "x"), (8, "y" * 100_000, "en", "c", "x"), (9, "</s>[INST] <|end|>\n", "en", "c", "x"), (10, "Ünïcödé “quotes” 漢字 ✓ İ Σ", "xx", "c", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumnRenamed("extra", "kept")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


# ---------------------------------------------------------------- shared


def test_word_hashes_follow_words():
    texts = ["a bb a", None, "", " bb\n\tccc ", "é " * 3, "x" * (3 << 20), ("long " * 300_000).strip()]
    hashes, at = shared.word_hashes(pa.array(texts))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    by_word = defaultdict(set)
    for h, w in zip(hashes.tolist(), [w for t in texts for w in words(t)], strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in nodes}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 1 and 4 and 5: SQL


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test data")
@pytest.mark.parametrize("module", [licenses, urls, chat])
def test_matches_sql(spark, module):
    ((name, query),) = module.QUERIES.items()
    found = query(spark, SMALLEST)
    con = duckdb.connect()
    for f in os.listdir(SMALLEST):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALLEST}/{f}')")
    wanted = con.execute(module.SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in found.collect()) == sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in wanted.fetchall())


def test_license_rules(spark, none):
    rows = [(1, "Intro.\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. More."), (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."), (3, "# SPDX-License-Identifier: MIT\nThen GPL: licensed under the GNU Affero General Public License, version 3"), (4, "the MIT license of nothing"), (5, None), (5, None), (None, "Released under the MIT License.")]
    known = licenses.known_sentences(spark)
    got = sorted(((r["doc_id"] or 0, r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()))
    assert got == [(0, ["MIT"]), (1, ["Apache-2.0"]), (2, ["BSD-2-Clause"]), (3, ["MIT", "AGPL-3.0"]), (4, []), (5, []), (5, [])]
    assert licenses.scan(none, known).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD + """
3. Neither the name of Some Owner Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
STANDARD = [
    (APACHE, "Apache-2.0", 3), (MIT, "MIT", 3), (GPL.format(":", "", 3), "GPL-3.0", 2), (GPL.format(";", "", 2), "GPL-2.0", 2), (GPL.format(":", "Affero ", 3), "AGPL-3.0", 2),
    (GPL.format(":", "Lesser ", 3), "LGPL-3.0", 2), (BSD, "BSD-2-Clause", 3), (BSD3, "BSD-3-Clause", 4), (MPL, "MPL-2.0", 2),
]


def test_standard_notices(spark):
    forms = [lambda t: t, lambda t: " ".join(t.split()), lambda t: "/*\n * Copyright 2020 Someone\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\ncode();", lambda t: "# Copyright Someone\n" + re.sub(r"((?:\S+\s+){3})", r"\1\n# ", t)]
    rows = [(10 * i + k, form(t)) for i, (t, _, _) in enumerate(STANDARD) for k, form in enumerate(forms)]
    got = {r["doc_id"]: (r["licenses"], r["sentences"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_sentences(spark)).collect()}
    assert got == {10 * i + k: ([name], n) for i, (_, name, n) in enumerate(STANDARD) for k in range(len(forms))}


def test_every_known_sentence_wrapped_or_not(spark):
    printed = [(s, i) for i, group in licenses.NOTICES.items() for s in group] + list(licenses.SENTENCES.items())
    rows = [(2 * k + w, "Before\n" + (re.sub(r"(\S+ \S+) ", r"\1\n// ", s) if w else s) + ".\nAfter") for k, (s, _) in enumerate(printed) for w in (0, 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_sentences(spark)).filter("sentences < 1").collect()
    assert got == []


def test_url_rules_nest(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/bad/", "block"), ("example.net", "/en/b", "allow"), ("EXAMPLE.com", "/de/", "block"), ("org", "", "block"), (None, "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://example.net/en/x": ("example.net/en/", "allow"), "http://a.b.example.net/en/bad/x": ("example.net/en/bad/", "block"), "http://example.net/en/bx": ("example.net/en/b", "allow"), "http://example.net/en": ("net/", "block"),
        "http://xexample.net/en/": ("net/", "block"), "http://net/": ("net/", "block"), "http://net": (None, "allow"), "https://M.Example.COM/de/?q": ("example.com/de/", "block"), "x.example.com/de/": (None, "allow"), "ftp://q.org": ("org", "block"),
        "http://org?x": ("org", "block"), "": (None, "allow"), None: (None, "allow"), "http://a..net/x": ("net/", "block"), "http://example.com/de": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)] * 2, "page_id int, url string, verdict string")
    for window_rows in (2, 1000):
        got = [(r["page_id"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules, ["page_id"], window_rows=window_rows).collect()]
        assert sorted(got, key=str) == sorted([(i, *v) for i, v in enumerate(cases.values())] * 2, key=str)
    shuffled = urls.filter_urls(pages, rules, ["page_id"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where nothing is small: windows stay dealt by salt
    try:
        shuffled.collect()
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(depth#\d+, prefix#\d+, salt#\d+", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r["verdict"] for r in urls.filter_urls(pages, rules.limit(0), ["page_id"]).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), rules, ["page_id"]).count() == 0


def test_chat_events(spark):
    log = [
        ("c", 1, "message", 1, "user", "hi"), ("c", 2, "message", 2, "assistant", "He"), ("c", 3, "delta", 2, None, "ll"), ("c", 4, "delta", 2, None, "o"), ("c", 5, "message", 3, "user", "old"),
        ("c", 6, "regenerate", 2, None, None), ("c", 7, "delta", 2, None, "By"), ("c", 8, "delta", 2, None, "e"), ("c", 9, "edit", 1, None, "hey"), ("d", 1, None, 1, None, None), (None, 1, "message", 1, "user", "n"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(log, "conv_id string, seq long, kind string, turn long, role string, text string")).collect()}
    assert got == {("c", 1): ("user", "hey"), ("c", 2): ("assistant", "Bye"), ("d", 1): (None, ""), (None, 1): ("user", "n")}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", r"<\|a|> <\\s> [\INST]", "", None, "a\nb%0A%25", "<<|<|\\|", "漢字"]
    rows = [("k", i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant", "sys%\ntem<|", None, "assistant", "assistant", "user", "assistant"], nasty, strict=True))] + [("k", 1, "assistant", nasty[1])]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    made = chat.render(chat.fold(chat.as_events(table)))
    back = chat.read_back(made).first()
    wanted = [(r or "", t or "") for _, _, r, t in sorted(rows, key=lambda x: (x[1], x[2] or "", x[3] or ""))]
    assert [(t["role"], t["text"]) for t in back["turns"]] == wanted
    assert back["learned"] == [t for r, t in wanted if r == "assistant"]
    assert back["formatted"].count("<|turn|>") == len(rows) and "</s>" not in back["formatted"] and "[INST]" not in back["formatted"]
    assert chat.render(table.limit(0)).count() == 0


# ---------------------------------------------------------------- 2


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000], [3, 1]) == pytest.approx([30, 980])
    assert mixing.targets([0, 5], [1, 2]) == pytest.approx([0, 5])
    assert mixing.targets([], []) == []


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        p = mixing.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert mixing.permute(p, n, 7, back=True).tolist() == list(range(n))


def test_shards_share_out_all_slots():
    counts = np.array([1000, 0, 37, 4000])
    of = mixing.shard_counts(counts, 13, 400, 5)
    first = np.zeros(4, np.int64)
    for shard in range(13):
        n, at = of(shard)
        assert at.tolist() == first.tolist() and n.sum() == min(400, counts.sum() - 400 * shard)
        first += n
    assert first.tolist() == counts.tolist()
    big = mixing._divide(np.array([3 * 10**9, 10**9]), 2 * 10**9, np.random.default_rng(0))
    assert big.sum() == 2 * 10**9 and abs(big[0] - 1.5e9) < 1e6


def brute_mix(rows, sources, block, salt, shard_slots):
    """Words taken, one by one: the slots of all shards, each of its words."""
    counts = np.array([s.slots for s in sources])
    shards = max(1, -(-int(counts.sum()) // shard_slots))
    of = mixing.shard_counts(counts, shards, shard_slots, salt)
    taken = Counter()
    for shard in range(shards):
        n, first = of(shard)
        for i, s in enumerate(sources):
            for k in range(first[i], first[i] + n[i]):
                b = int(mixing.permute(np.array([k % s.blocks]), s.blocks, mixing._key(i, int(k // s.blocks)))[0])
                for w in range(b * block, min(s.words, b * block + (s.last or block if k == s.slots - 1 else block))):
                    taken[i, w] += 1
    return taken


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 90)), ["b", "a", None, "c"][min(3, int(rng.integers(0, 6)))]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(docs, block=8, shard_slots=50, salt=1).collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    names = sorted(size, key=lambda n: (n is None, n or ""))
    goal = mixing.targets([size[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    sources = [mixing.plan(n, size[n], t, i, 8) for i, (n, t) in enumerate(zip(names, goal, strict=True))]
    taken = brute_mix(rows, sources, 8, 1, 50)
    for i, n in enumerate(names):
        mine = [r for r in got if r["source"] == n]
        assert sum(r["taken"] for r in mine) == sum(v for (j, _), v in taken.items() if j == i) == round(goal[i])
        assert {(r["source_size"], round(r["target"], 6)) for r in mine} == {(size[n], round(goal[i], 6))}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_documents(docs, block=8, shard_slots=50, salt=1).collect()), key=str)


def test_mix_is_made_of_slots(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " \n".join(f"w{i}.{k}" for k in range(int(rng.integers(0, 90)))), "ab"[i % 2]) for i in range(60)] + [(100, " ".join(f"x{k}" for k in range(3000)), "b"), (101, "twice the same", "a"), (101, "twice the same", "a"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block": 8, "shard_slots": 50, "salt": 1}
    text = {(r["doc_id"], r["h"]): words(r["text"]) for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    spans = mixing.mix_spans(docs, **options).collect()
    size = Counter()
    for _, t, n in rows:
        size[n] += len(words(t))
    names = ["a", "b", None]
    goal = mixing.targets([size[n] for n in names], list(mixing.WEIGHTS))
    sources = [mixing.plan(n, size[n], t, i, 8) for i, (n, t) in enumerate(zip(names, goal, strict=True))]
    laid = {n: [None] * size[n] for n in names}  # the words of each source end to end
    for r in spans:
        for k in range(r["n"]):
            laid[r["source"]][r["start"] + r["first"] + k] = text[r["doc_id"], r["h"]][r["first"] + k]
    made = defaultdict(list)
    for r in sorted(spans, key=lambda r: r["at"]):
        made[r["shard"], r["slot"], r["source"]] += text[r["doc_id"], r["h"]][r["first"] : r["first"] + r["n"]]
    counts = np.array([s.slots for s in sources])
    shards = -(-int(counts.sum()) // 50)
    of, wanted = mixing.shard_counts(counts, shards, 50, 1), {}
    for shard in range(shards):
        n, first = of(shard)
        order, at = mixing.permute(np.arange(n.sum()), int(n.sum()), int(shared.seed("shard", 1, shard))).tolist(), 0
        for i, s in enumerate(sources):
            for k in range(first[i], first[i] + n[i]):
                b = int(mixing.permute(np.array([k % s.blocks]), s.blocks, mixing._key(i, int(k // s.blocks)))[0])
                wanted[shard, order[at], s.name] = laid[s.name][b * 8 : min(s.words, b * 8 + (s.last or 8 if k == s.slots - 1 else 8))]
                at += 1
    assert made == wanted
    taken, emitted = Counter(), Counter()
    for r in spans:
        taken.update((r["doc_id"], w) for w in text[r["doc_id"], r["h"]][r["first"] : r["first"] + r["n"]])
    for r in mixing.mixed(docs, **options).collect():
        emitted.update((r["doc_id"], w) for w in words(r["text"]))
    assert emitted == taken and sum(taken.values()) == sum(map(round, goal))
    assert sum(r["taken"] for r in mixing.mix_documents(docs, **options).collect()) == sum(taken.values())


def test_mix_odd(spark, odd, none):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == len(ODD) and mixing.mix_documents(none).count() == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_documents(odd.filter("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed(odd).columns == odd.columns


# ---------------------------------------------------------------- 3


def longest_matches(text, sample):
    """Phrases by definition: the longest piece that the sample holds, at least one character, again and again."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrases_by_definition():
    samples = {"a": ["the cat sat on the mat and the rat"], "b": ["le chat est sur le tapis et le rat"]}
    model = language.train(samples)
    texts = ["the rat sat", "le tapis", "zzz the q", "x"]
    found, _ = language.phrases(texts, model)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert found[i, k] == longest_matches(t + " ", samples[lang][0] + " ")


def test_phrases_run_over_lanes_and_segments(monkeypatch):
    rng = np.random.default_rng(8)
    words_of = {"a": "the cat sat on the mat and the rat".split(), "b": "le chat est sur le tapis et un rat".split()}
    samples = {k: [" ".join(rng.choice(v, 300))] for k, v in words_of.items()}
    model = language.train(samples)
    texts = [" ".join(rng.choice([*words_of["a"], *words_of["b"], "zq"], n)) for n in (1, 100, 1500, 3000)] + ["ab" * 3000, "a" * 5000, "cat " * 900, "x"]
    for segment in (1 << 21, 700):
        monkeypatch.setattr(language, "SEGMENT", segment)
        found, _ = language.phrases(texts, model)
        assert found.tolist() == [[longest_matches(t + " ", samples[k][0] + " ") for k in model.languages] for t in map(lambda t: re.sub(" +", " ", t + " ")[:-1], texts)]


def test_rare_letters_are_digits(monkeypatch):
    monkeypatch.setattr(language, "FREQUENT", 3)
    han = "".join(chr(0x4E00 + 7 * i) for i in range(500))
    samples = {"zh": [han * 3], "en": ["the cat sat on the mat " * 20]}
    model = language.train(samples)
    assert model.alphabet.letters == 3 + language.DIGITS + 2 and model.alphabet.width == 2
    assert language.predict([han[100:400], "the mat sat", han[7:9], "Ω"], model)[0][:3] == ["zh", "en", "zh"]
    found, _ = language.phrases([han[100:400]], model)
    assert found[0, model.languages.index("zh")] <= 2
    monkeypatch.setattr(language, "CELLS", 40_000)
    assert len(language.train(samples).table) <= 40_000


def test_language_edges(spark, odd, none):
    model = language.learn(odd)
    got = language.identify(odd, model, ["doc_id", "kept"]).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(none, language.learn(none), ["doc_id"]).count() == 0
    assert language.predict(["abc"], language.train({})) == (["und"], [0.0])


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test data")
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").select("doc_id", "lang")
    joined = language.op3_language_id(spark, SMALLEST).join(docs, "doc_id").filter("held_out")
    right, n = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 30 and right > 0.95


# ---------------------------------------------------------------- 6


def test_media_round_trip(spark, odd, none):
    folder = shared.shared_dir(spark)
    got = media.media_columns(odd, "doc_id", folder).collect()
    wanted = Counter()
    for doc_id, text, *_ in ODD:
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = media.encode(payload)
        assert media.decode(stored) == payload
        wanted[doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload)] += 1
    assert Counter(tuple(r) for r in got) == wanted
    assert media.media_columns(none, "doc_id", shared.shared_dir(spark)).count() == 0


def test_media_ranges_and_damage(spark, tmp_path):
    named = spark.createDataFrame([(f"n{i}", f"text {i} " * i) for i in range(50)], "name string, text string")
    folder = f"file://{tmp_path}/m"
    assert sum(r["members"] for r in media.write_archives(named.coalesce(1), folder, archive_bytes=2000).collect()) == 50
    spark.dataSource.register(media.MediaArchive)
    read = lambda **o: spark.read.format("media_archive").options(**o).load(folder)
    assert {r["name"] for r in read(rangeBytes=300).collect()} == {f"n{i}" for i in range(50)}
    archive = sorted((tmp_path / "m").glob("*.zip"))[0]
    data = bytearray(archive.read_bytes())
    data[60] ^= 255
    archive.write_bytes(data)
    rows = read(onError="row", tries=2).collect()
    assert len(rows) == 50 and sum(r["media"] is None and r["error"] is not None for r in rows) == 1


def test_retries():
    left = [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("later")
        return b"x"

    assert media.with_retries(flaky, 3, 0) == (b"x", None)
    assert media.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), 2, 0) == (None, "OSError: no")


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"), ("<b>x</b> <i>y</i>\n z", "x y z"),
        ("<ul><li>a<li>b<ol start=3><li>c</ul>d", "- a\n- b\n  3. c\n\nd"), ("<head><title>t</title></head><body>x", "x"), ("<script>var a='</p>';</script>x<style>p{}</style>", "x"),
        ("<p hidden>a</p><p style='display: none'>b</p><p style='visibility:hidden'>c</p><p aria-hidden=true>d</p>", "d"), ("<img alt='a cat'> here", "a cat here"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"), ("<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>", "wide  z\n1  2  3"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<blockquote>q</blockquote><dl><dt>t<dd>d</dl>", "    q\n\nt\n    d"), ("<!-- no --><!doctype html>x<![CDATA[y]]>", "xy"), ("< b>x</ b><a href='>'>y</a>", "< b>xy"), ("<input type=hidden value=a><input type=submit value=Go>", "Go"), ("a</p></div>b", "ab"),
    ],
)
def test_html(source, text):
    assert html_text.render(source) == text


def test_html_deep_and_edges(spark):
    assert html_text.render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    deep = "<div>" * 400 + '<img alt="cat"><pre>a\n  b</pre><ul><li>x<li>y</ul>' + "</div>" * 400
    assert html_text.render(deep) == "cat\n\na\n  b\n\n- x\n- y"
    assert html_text.render("<a href=\"x>" * 2000).count("x") >= 0
    table = spark.createDataFrame([(1, None, "t"), (1, "<p>x", "t"), (None, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_lines"]) for r in html_text.extract(table, ["page_id"]).collect()) == [(0, "x", 1, 1), (1, "", 0, 0), (1, "x", 1, 1)]
    assert html_text.extract(table.limit(0), ["page_id"]).count() == 0


def built_page(r, depth=0, seen=True):
    """A random piece of markup, and the words that a reader sees of it, in order: known as it is built."""
    word = f"w{r.randrange(10**6)}"
    kind = r.randrange(14) if depth < 7 else 0
    if kind < 3:
        return f" {word} ", [word] if seen else []
    if kind == 3:
        return f"<{(h := r.choice(['script', 'style', 'noscript', 'template']))}>{word}</{h}>", []
    if kind == 4:
        return f"<!-- <p>{word}</p> -->", []
    if kind == 5:
        return f'<img alt="{word}">', [word] if seen else []
    inner, shown = map(list, zip(*(built_page(r, depth + 1, seen and kind not in (6, 7)) for _ in range(r.randrange(1, 4))), strict=True))
    body, shown = "".join(inner), [w for ws in shown for w in ws]
    if kind in (6, 7):
        return f"<div {r.choice(['hidden', 'style=\"display:none\"', 'STYLE = display:none'])}>{body}</div>", []
    if kind == 8:
        return f"<ul><li>{body}<li>{word}</ul>", [*shown, *([word] if seen else [])]
    if kind == 9:
        return f"<table><tr><td>{word}<td>{word}x<tr><td>{word}y</table>", [word, word + "x", word + "y"] if seen else []
    if kind == 10:
        return f"<p>{word}<div>{body}</div>", [*([word] if seen else []), *shown]
    return f"<{(t := r.choice(['div', 'section', 'span', 'b', 'blockquote', 'a']))} title='not > shown'>{body}</{t}>", shown


def test_all_visible_text_and_nothing_else():
    r = random.Random(7)
    for _ in range(300):
        parts = [built_page(r) for _ in range(6)]
        got = re.findall(r"w[0-9]+[xy]?", html_text.render("<!doctype html><body>" + "".join(p for p, _ in parts)))
        assert got == [w for _, ws in parts for w in ws]


@pytest.mark.parametrize("piece", ['<a x= "', "<a ", "<!--", "<![CDATA[", "</p", "<p>", "<table><tr><td>", "<b><p>", "&#", "<textarea>", "<li><ul>", "<a b='c", "< ", "<a/", "=", "</table>", "<select><option>", '<td rowspan=65534 colspan=1000>'])
def test_hostile_pages_are_linear(piece):
    import time

    began = time.time()
    html_text.render(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20


# ---------------------------------------------------------------- 8


def brute_signals(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_against_brute_force(spark, odd, none):
    texts = [None, "", "a b c d e a b c d e f", "x\ny\nx\n \n\nx", "# * $ | a", "a a a a a a a", "u v w x y z " * 2 + "end", "é ü\x0bz\x0c"]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + ODD[:-1]
    got = quality.judge(spark.createDataFrame(rows, DOCS), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        wanted = brute_signals(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == wanted
        assert r["base_failed"] == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none, ["doc_id"]).count() == 0


def test_fences_adapt(spark):
    clean = [(i, f"these are {i} ordinary words number {i * 7} of a clean line of text", "en", "a", None) for i in range(300)]
    code = [(1000 + i, f"$x{i} = #a{i} | b{i} & c{i} < d{i} > e{i} * f{i} % g{i} $h{i} #k{i}", "en", "code", None) for i in range(300)]
    junk = [(5000, " ".join(f"w{i}$$$" for i in range(30)), "en", "a", None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(clean + code + junk, DOCS), ["doc_id"]).collect()}
    assert not got.pop(5000)
    assert all(got.values())


def test_fences_follow_their_group(spark):
    """Groups with other habits get other fences, on both sides; only a group without any spread takes the fixed distance."""
    r = random.Random(8)
    prose = lambda i, src, letters, marks: (i, " ".join("x" * r.choice(letters) + r.choice(marks) for _ in range(60)), "en", src, None)
    rows = [prose(i, "short", [3, 4, 5], ["", "", "."]) for i in range(200)] + [prose(300 + i, "long", [11, 12, 13, 14, 15], ["", ".", "!", "?.."]) for i in range(200)]
    rows += [(600 + i, "one two three four five six seven eight nine ten", "en", "same", None) for i in range(200)]
    rows += [prose(900, "short", [13], [""]), prose(901, "long", [13], [""]), prose(902, "long", [4], [""])]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, DOCS), ["doc_id", "source"]).collect()}
    fence = {x["source"]: x for x in got.values()}
    assert fence["short"]["hi_length"] < fence["long"]["lo_length"] and fence["short"]["hi_marks"] < fence["long"]["hi_marks"]
    assert abs(fence["same"]["hi_length"] - fence["same"]["lo_length"] - 6) < 1e-9
    assert not got[900]["kept"] and not got[902]["kept"]


# ---------------------------------------------------------------- 9


def test_word_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, tokenizer = packing.Ids(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    letters = [chr(c) for c in range(33, 0x260)] + list("'sdltmrve'ABC  \t\n²½ǅµªßſΣς漢́­\x85\xa0")
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 14))))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(20, "a\x1cb <|endoftext|> c's don't x\x85y", "en", "a", "x"), (21, "word, " * 9000, "en", "a", "x")]
    docs = odd.unionByName(spark.createDataFrame(extra, DOCS).withColumnRenamed("extra", "kept"))
    got = packing.pack_documents(docs, path, capacity=512, group_tokens=20_000).collect()
    wanted = Counter()
    for doc_id, text, *_ in ODD + extra:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            wanted[doc_id, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 512
    assert packing.pack_documents(none, path).count() == 0


def test_sum_of_squares_by_definition():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 41, 300).tolist()
    where, offset, n = packing.sum_of_squares(lengths, 40)
    fill = Counter()
    for length, w, at in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        gaps = Counter(40 - f for f in fill.values() if f < 40)
        cost = lambda g, gaps=gaps, length=length: sum(v * v for v in (gaps - Counter({g: 1}) + Counter({g - length: 1} if g > length else {})).values())
        options = {g: cost(g) for g in gaps if g >= length} | {41: sum(v * v for v in (gaps + Counter({40 - length: 1} if length < 40 else {})).values())}
        assert at == fill[w]
        chosen = 40 - fill[w] if fill[w] else 41
        assert options[chosen] == min(options.values())
        fill[w] += length
    assert n == len(fill) and max(fill.values()) <= 40
    pieces = sorted(rng.integers(1, 2000, 3000).tolist(), reverse=True)
    assert packing.sum_of_squares(pieces, 4096)[2] <= -(-sum(pieces) // 4096) * 1.01 + 1


# ---------------------------------------------------------------- 10


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], least[find(i)], links[i]) for i in range(len(rows))), key=str)


def test_jaccard_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choice(vocabulary, 40).tolist()
    rows = [(None, None), (0, ""), (1, "a b"), (2, "a b"), (3, "a b c"), (4, "word " * 5000)]
    base = rng.choice(vocabulary, 120).tolist()
    for i in range(70):  # near copies at all distances, in one group too large for a bucket
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            copy[at] = f"new{i}"
        rows.append((100 + i, " ".join(copy)))
    for i in range(60):  # a passage that many share, which links none
        rows.append((300 + i, " ".join([*rng.choice(vocabulary, 60), *passage, *rng.choice(vocabulary, 60)])))
    rows += [(500, rows[80][1]), (500, rows[80][1]), (501, " ".join(passage)), (502, " ".join([*passage, "end"]))]
    monkeypatch.setattr(jaccard, "BUCKET", 12)
    monkeypatch.setattr(jaccard, "LAST_BLOCK", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_one_of_each_stays(spark, odd, none):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 4, 5, 7, 8, 9, 10]
    assert jaccard.jaccard_classes(none).count() == 0


def _rows_made(spark, node, query):
    """Rows that all plan nodes of that name made while query ran, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {(e := store.executionsList().apply(i)).executionId() for i in range(store.executionsList().size())}
    before = ids()
    query()
    made = 0
    for e in ids() - before:
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for i in range(nodes.size()):
            if nodes.apply(i).name() != node:
                continue
            metrics = nodes.apply(i).metrics()
            for k in range(metrics.size()):
                if metrics.apply(k).name() == "number of output rows" and (v := values.get(metrics.apply(k).accumulatorId())).isDefined():
                    made += int(v.get().replace(",", ""))
    return made


def test_jaccard_opens_lists_of_large_buckets_only(spark, monkeypatch):
    """Paths below the first level are rows for texts that share a large bucket, once a level: 13, 16 and 20 a text, not for all texts and again for each plan."""
    rng = random.Random(5)
    alone = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))) for i in range(400)]
    base = [f"c{k}" for k in range(60)]
    near = [(1000 + i, " ".join([*base, f"end{i}"])) for i in range(30)]
    monkeypatch.setattr(jaccard, "BUCKET", 12)
    monkeypatch.setattr(jaccard, "LAST_BLOCK", 20)
    docs = spark.createDataFrame(alone + near, "doc_id long, text string")
    got = []
    made = _rows_made(spark, "Generate", lambda: got.extend(jaccard.jaccard_classes(docs).select("doc_id", "class_id").collect()))
    assert {r.doc_id: r.class_id for r in got} == {i: i if i < 1000 else 1000 for i, _ in alone + near}
    assert 400 * 10 < made < 430 * 17 + 30 * 60
