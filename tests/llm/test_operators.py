"""Operators against brute force and against the awkward rows: nulls, empties, repeats, long texts, other columns."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookwave.llm import chat_formatting, decontamination, licences, lm_scoring, near_duplicates, packing, quality_classifier, quality_rules, toxicity, url_filters
from tests.comparing import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, key long, row long"


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "su"], r.integers(1, 4))) for _ in range(n))


LONG = prose(1, 30_000)
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, LONG), (7, prose(2, 300)), (7, prose(2, 300)), (8, "Ünï cödé " * 30)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def words_of(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_urls(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "nothing", "x"), (4, "HTTP://A.Example.NET/en/x?q#f", "x"), (5, "http://example.net", "x"), (6, "http://xnet/", "x"), (6, "http://a.net/", "x"), (7, "http://a.org/fr/", "x"), (8, "https://casino-win.example.com/en/1", "x"), (9, "http://notexample.com/de/", "x"), (10, "http://net/a", "x")], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(d).collect()]
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (5, "example.net", "", None, "allow"), (6, "xnet", "/", None, "allow"), (6, "a.net", "/", "net/", "block"), (7, "a.org", "/fr/", "org/fr/", "allow"), (8, "casino-win.example.com", "/en/1", None, "block"), (9, "notexample.com", "/de/", None, "allow"), (10, "net", "/a", "net/", "block")]
    assert url_filters.filter_urls(d.limit(0)).count() == 0


def test_licences(spark):
    mit = " ".join(licences.SENTENCES[k] + "." for k in ("mit/title", "mit/grant", "mit/include"))
    d = frame(spark, [*AWKWARD, (20, f"Some prose.\nLicensed under the Apache License, Version 2.0.\nmore. {LONG}"), (21, "Copyright (c) 2020 A B\nAll rights reserved."), (22, "Words.\n" + mit), (23, "SPDX-License-Identifier: MPL-2.0"), (24, "The license of it is free. You may go.")])
    got = {r.doc_id: r for r in licences.scan_licences(d).collect()}
    assert got[20].licences == ["Apache-2.0"] and got[21].licences == ["All-Rights-Reserved"] and got[23].licences == ["MPL-2.0"] and got[24].licences == [] and got[1].licences == []
    assert "MIT" in got[22].licences
    assert licences.scan_licences(d).count() == len(AWKWARD) + 5


@pytest.mark.parametrize("licence, ids", licences.RULES)
def test_each_licence_rule_on_its_own_text(licence, ids):
    variable = {"copyright/line": "Copyright (c) 2020 A B", "spdx/tag": "SPDX-License-Identifier: SPDX"}
    n, found, got = licences.scan("Words.\n" + "\n".join(variable.get(i) or licences.SENTENCES[i].rstrip(":") + "." for i in ids))
    assert found == list(ids) and [x[0] for x in got] == [licence]


GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
NO_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl "])
@pytest.mark.parametrize("text, licence, n", [(GPL.format(":", ",", 3), "GPL-3.0-or-later", 2), (GPL.format(";", ";", 2), "GPL-2.0-or-later", 2), (BSD.format(""), "BSD-2-Clause", 4), (BSD.format(NO_ENDORSE), "BSD-3-Clause", 5), (APACHE, "Apache-2.0", 4), (MPL, "MPL-2.0", 1), (MIT, "MIT", 2), ("All rights reserved.", "All-Rights-Reserved", 1)])
def test_licence_notices_as_they_are_wrapped(mark, text, licence, n):
    wrapped = "\n".join(mark + line for line in text.split("\n"))
    found, got = licences.scan(wrapped)[1:]
    assert [x[0] for x in got] == [licence] and len(found) == n


def test_lm_scores(spark, documents, texts):
    train = ~toxicity.held_out("doc_id", 7, 2)
    got = lm_scoring.lm_scores(documents, train).collect()
    tokens = {i: [w.encode() for w in words_of(lowered(t))] + [None] for i, t in texts.items()}
    n = collections.Counter(w for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens[i])
    total, distinct = sum(n.values()), len(n)
    assert len(got) == len(texts)
    for r in got:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(n[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((n[x] + 1) / (total + distinct + 1)) for x in w))
        assert r.score < 0 and math.isfinite(r.score)


def test_trie_is_a_distribution_and_scores_as_by_hand():
    text = " ".join([prose(3, 400)] * 2).encode()
    order = 3
    keys, n = np.unique(lm_scoring.grams(np.concatenate([np.full(order, 256), np.frombuffer(text, np.uint8), [256]]).astype(np.int64), order), return_counts=True)
    trie = lm_scoring.Trie(keys, n, order, share=200)
    assert np.allclose((10 ** trie.length.astype(float)).sum(axis=1), 1, atol=1e-4)

    def by_hand(t):
        s = [int(trie.symbol[256])] * order + [int(trie.symbol[b]) for b in t] + [int(trie.symbol[256])]
        out = 0.0
        for k in range(order, len(s)):
            node = 0
            for j in range(1, order + 1):
                if trie.child[node, s[k - j]] < 0:
                    break
                node = trie.child[node, s[k - j]]
            out += float(trie.length[node, s[k]]) - (math.log10(256) if s[k] == trie.width - 1 else 0)
        return out

    samples = ["bado kilu", "", "zzz bado", prose(5, 60)]
    assert np.allclose(trie.scores(samples), [by_hand(x.encode()) for x in samples])
    assert trie.scores([LONG])[0] == pytest.approx(by_hand(LONG.encode()), rel=1e-6)


def by_definition(train, text, order=5):
    """Prediction by partial matching from its definition, with counts in plain dictionaries."""
    n = collections.defaultdict(collections.Counter)
    for t in train:
        s = [256] * order + list(t) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                n[tuple(s[i - k : i])][s[i]] += 1
    known = {256} | set(n[()])

    def p(context, symbol):
        if not context and not n[()]:
            return 1 / (len(known) + 1)
        if not n[context]:
            return p(context[1:], symbol)
        c = n[context]
        lower = (lambda x: p(context[1:], x)) if context else lambda x: 1 / (len(known) + 1)
        left = 1 - sum(lower(x) for x in c)
        total = sum(c.values())
        if symbol in c:
            return (c[symbol] - 0.5) / total
        return len(c) / (2 * total) * lower(symbol) / left

    s = [256] * order + list(text) + [256]
    return sum(math.log10(p(tuple(s[i - order : i]), x) if x in known else p(tuple(s[i - order : i]), -1) / 256) for i, x in enumerate(s) if i >= order)


def test_lm_score_by_its_definition(spark):
    texts = [(i, prose(i, 12)) for i in range(1, 9)] + [(9, "bado zz"), (10, "")]
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(frame(spark, texts), F.col("doc_id") < 7).collect()}
    train = [t.encode() for i, t in texts if i < 7]
    for i, t in texts:
        assert got[i] == pytest.approx(by_definition(train, t.encode()), rel=1e-5)


def test_lm_awkward(spark):
    got = lm_scoring.lm_scores(frame(spark, AWKWARD), ~toxicity.held_out("doc_id", 7, 2)).collect()
    assert len(got) == len(AWKWARD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm_scoring.lm_scores(frame(spark, AWKWARD).limit(0), ~toxicity.held_out("doc_id", 7, 2)).count() == 0


def test_every_context_of_training_counts(spark, monkeypatch):
    """The tables equal the model in memory with every context, however small its share; held-out bytes that training lacks too."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 20_000)
    monkeypatch.setattr(lm_scoring, "KEYS", 500)
    rare = [(i, f"{prose(i, 200)} q{i}x") for i in range(1, 60)] + [(101, "zü q5x bado"), (102, ""), (103, None), (104, LONG)]
    train = ~toxicity.held_out("doc_id", 7, 2)
    d = frame(spark, rare)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(d, train).collect()}
    stream = [lm_scoring.grams(lm_scoring._stream(b" ".join(lm_scoring.tokens_of(t)), 5), 5) for i, t in rare if not got[i].held_out]
    trie = lm_scoring.Trie(*np.unique(np.concatenate(stream), return_counts=True))
    assert any(r.held_out for r in got.values()) and len(got) == len(rare)
    assert [got[i].score for i, _ in rare] == pytest.approx(trie.scores([t for _, t in rare]).tolist(), rel=1e-5)
    joined = {r.doc_id: r for r in lm_scoring.lm_scores(d, train, model_rows=0).collect()}  # a model too large to be sent out
    assert [joined[i].score for i, _ in rare] == pytest.approx([got[i].score for i, _ in rare], rel=1e-5)
    assert all(joined[i][:6] == got[i][:6] for i, _ in rare)
    # one rare word among more than 131072 times as many bytes still is a context
    many = [(i, "ba " * 50_000) for i in range(1, 8)] + [(8, "quixotic"), (9, "quixotic"), (10, "quixotix")]
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(frame(spark, many), F.col("doc_id") < 9).collect()}
    assert got[9] > got[10] and got[9] > -12


def divergences(t):
    """Both distances to each language, from their definition."""
    w, size = words_of(t), max(1, len(t or ""))
    upper, digit, sign, stop = (sum(c in x for c in t or "") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@^_~=+/\\[]{}`", ".,;:!?'\"()-"))
    blank = len(t or "") - sum(map(len, w))
    p = [max(0, len(t or "") - upper - digit - sign - stop - blank), upper, digit, blank, stop, sign]

    def js(p, q):
        part = lambda a, b: a * math.log2(a / ((a + b) / 2)) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))

    out = {}
    for lang, own in quality_rules.WORDS.items():
        n = [sum(x in (k, k.capitalize(), k.upper()) for x in w) / max(1, len(w)) for k in own]
        out[lang] = js([x / size for x in p], quality_rules.CLASSES[lang]), js([*n, 1 - sum(n)], [*own.values(), 1 - sum(own.values())])
    return out


def expected_verdict(t):
    w = words_of(t)
    by_class, by_word = sum(map(len, w)) >= quality_rules.MIN_CHARS, len(w) >= quality_rules.MIN_COMMON_WORDS
    lang, (a, b) = min(divergences(t).items(), key=lambda x: x[1][0] * by_class + x[1][1] * by_word)
    ok = (not by_class or a <= quality_rules.MAX_CLASS_DISTANCE) and (not by_word or b <= quality_rules.MAX_WORD_DISTANCE)
    return (lang if by_class or by_word else None, a if by_class else None, b if by_word else None, ok and not expected_rules(t)[5])


def expected_rules(t):
    w = words_of(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark, documents, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in quality_rules.judged(documents).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_rules(texts[r.doc_id])
        lang, a, b, kept = expected_verdict(texts[r.doc_id])
        assert (r.language, r.kept) == (lang, kept) and (r.class_distance, r.word_distance) == (pytest.approx(a), pytest.approx(b))
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
    assert quality_rules.judged(documents.limit(0)).count() == 0
    more = [(30, "a b c a b c a"), (31, "x\nx\n\n \nx y\nx"), (32, "☃ 😀 #a*\x1c|b\n" * 3), (33, "a " * 5000)]
    for r in quality_rules.judged(frame(spark, AWKWARD + more)).collect():
        t = dict(AWKWARD + more)[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_rules(t), t


def brute_components(texts):
    sets, first, root = {}, {}, {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(a, b):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)

    for i, t in sorted(texts.items()):
        w = words_of(lowered(t))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
        sets[i] = s
        if s and s in first:
            link(first[s], i)
        first.setdefault(s, i)
    held = collections.defaultdict(list)
    for s, i in first.items():
        n = collections.Counter(j for g in s for j in held[g])
        for j, both in n.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                link(i, j)
        for g in s:
            held[g].append(i)
    return {i: (len(sets[i]), top(i)) for i in texts}


def near_copies():
    """Chains and stars of edited copies, more than a block of them."""
    r, out = np.random.default_rng(4), {}
    for g in range(3):
        base = prose(100 + g, 150).split()
        for k in range((120, 12, 3)[g]):
            w = list(base)
            for _ in range(int(r.integers(0, 5))):
                w[int(r.integers(len(w)))] = f"w{int(r.integers(10 ** 6))}"
            out[1000 * g + k] = " ".join(w)
    return out | {5000: None, 5001: "", 5002: "a b", 5003: "A  b", 5004: prose(1, 400), 5005: prose(1, 400).upper()}


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates(spark, block):
    texts = near_copies()
    got = near_duplicates.near_duplicates(frame(spark, list(texts.items())), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_jobs_hold_any_two_and_few_bytes():
    for sizes in ([], [5], [3, 9], [1] * 30, [40, 1, 1, 50, 2, 60, 7], [200, 300, 1, 2, 3]):
        jobs = near_duplicates.jobs_of(sizes, 64)
        assert {(a, b) for j in jobs for a in j for b in j} == {(a, b) for a in range(len(sizes)) for b in range(len(sizes))}
        assert all(sum(sizes[k] for k in j) <= 64 or len(j) <= 2 or sum(sorted(sizes[k] for k in j)[:-1]) <= 32 for j in jobs)


def test_every_pair_within_the_signature_distance_has_a_key():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 16, near_duplicates.PERMUTATIONS).astype("<u2")
    for _ in range(300):
        other = base.copy()
        other[near_duplicates.CHUNKS * near_duplicates.CHUNK :] ^= 1  # all that is not indexed differs
        other[r.permutation(near_duplicates.CHUNKS * near_duplicates.CHUNK)[: near_duplicates.NEAR]] ^= 1
        signs = np.stack([base, other])
        a, b = near_duplicates.keys_of(signs)
        places = np.flatnonzero(a == b)
        assert len(places) and sum(near_duplicates.taken_up(signs, int(p), 0).all() for p in places) == 1


def test_small_jobs_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "JOB_BYTES", 5_000)
    texts = near_copies()
    got = near_duplicates.near_duplicates(frame(spark, list(texts.items()))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_near_duplicates_awkward(spark, documents, texts):
    assert len(near_duplicates.near_duplicates(frame(spark, AWKWARD)).collect()) == len(AWKWARD)
    assert near_duplicates.near_duplicates(frame(spark, AWKWARD).limit(0)).count() == 0
    got = near_duplicates.near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_packing(spark, documents, texts):
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    for docs, known in ((documents, texts), (frame(spark, [x for x in AWKWARD if x[0] != 7]), dict(AWKWARD))):
        known = {i: t for i, t in known.items() if docs is documents or i != 7}
        ids = {i: [*e.ids, 2] for i, e in zip(known, whole.encode_batch([t or "" for t in known.values()], add_special_tokens=False))}
        pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(docs, path, window_sequences=16).collect():
            pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
            filled[r.sequence_id].append((r.offset, r.length))
        assert pieces.keys() == ids.keys()
        for i, found in pieces.items():
            at = 0
            for start, n, crc, total in sorted(found):
                assert start == at and total == len(ids[i]) and crc == zlib.crc32(np.array(ids[i][start : start + n], "<u4").tobytes())
                at += n
            assert at == len(ids[i])
        for found in filled.values():
            at = 0
            for offset, n in sorted(found):
                assert offset == at
                at += n
            assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two
    assert packing.pack(documents.limit(0), path).count() == 0


def test_chunks_equal_the_tokenizer():
    chunks = packing.Chunks(packing.default_tokenizer())
    odd = ["Don't we're IT'S", "ΣΑΣ σΑΣ", "ábc é", "x<|endoftext|>y", "12ab3,,'s", "naïve—ok…", "a\x1cb", "İstanbul", "a\xa0b　c", ")'s('ll", "it's.", "ﬁ ①²", "<|a|>", "...", "a_b", "😀!!"]
    for text, got in zip(odd, chunks.ids(odd)):
        assert got.tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_token_merges_back_to_itself():
    """What makes both byte-pair mergers agree: a token's own symbols merge into it."""
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(merges)}
    for a, b in list(rank):
        token = a + b
        end = token.endswith("</w>")
        s = list(token[:-4] if end else token)
        if end:
            s[-1] += "</w>"
        while len(s) > 1:
            k = min(range(len(s) - 1), key=lambda k: rank.get((s[k], s[k + 1]), 1 << 30))
            if (s[k], s[k + 1]) not in rank:
                break
            s[k : k + 2] = [s[k] + s[k + 1]]
        assert s == [token]


def test_lowest_cost_sequence_gets_the_longest_piece():
    got = packing.assigned([3, 5, 2, 6], [8, 8])
    assert got == [(3, 0, 6, 0), (1, 0, 5, 1), (0, 0, 3, 1), (2, 0, 2, 0)]
    assert sum(n for _, _, n, _ in packing.assigned([7, 7, 7], [16, 4, 1])) == 21


def test_toxicity(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert not any(r.predicted for r in held if not r.toxic)
    english = [r for r in held if r.toxic and r.lang == "en"]
    assert sum(r.predicted for r in english) >= 0.9 * len(english) > 0
    got = toxicity.toxicity(frame(spark, AWKWARD), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(documents.limit(0), labels.limit(0)).count() == 0


CURVE = [-5.1, 1.56, 0.09, 4.91]  # as fitted on the larger table


def test_grammar():
    g = toxicity.Grammar({"=idiot": 4.0, "^zorkl": 3.0}, CURVE)
    total = lambda t: sum(g.clauses(t))
    assert total("you are an idiot.") > total("such an idiot.") > total("he was not an idiot.") == 0
    assert 0 < total("they said that idiot spoke") < total("they met that idiot there")
    assert total("zorkling") == toxicity.LONE * 3.0 and total("zorkling idiot") == 7.0
    assert total("I will kill you") > 0 and total("the kill switch") == 0 and total("") == 0
    assert len(g.clauses("idiot. idiot! fine. idiot")) == 3


@pytest.mark.parametrize("part, text, verdict", [("TARGETS", "you are a twit and that is all of it", True), ("NEGATIONS", "he is not an idiot", False), ("REPORTS", "she said that he is an idiot", False), ("INTENTS", "i will kill you", True), ("THREATS", "i will kill you", True)])
def test_each_transducer_decides(monkeypatch, part, text, verdict):
    g = lambda: toxicity.Grammar({"=idiot": 4.0, "=twit": 1.5}, CURVE)
    assert (g().score(text) >= toxicity.THRESHOLD) == verdict
    monkeypatch.setattr(toxicity, part, set())
    assert (g().score(text) >= toxicity.THRESHOLD) != verdict


def test_learned_grammar_leaves_plain_words_alone(spark, documents):
    g = toxicity.learn(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    assert not any(f[0] == "^" and len(f) < 6 for f in g.weights)
    for text in ("The idea of the class display is clear.", "He has no idea.", "He is not an idiot.", "The kill switch works.", "", None):
        assert g.score(text) < toxicity.THRESHOLD, text
    for text in ("You are a fool and a coward.", "You are an idiot.", "I will kill you."):
        assert g.score(text) >= toxicity.THRESHOLD, text


def test_toxicity_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    odd = labels.union(labels).union(spark.createDataFrame([(1, 7), (2, -1), (None, 1), (3, None)], "doc_id long, toxic int"))
    a, b = (toxicity.learn(documents, x) for x in (labels, odd))
    assert a.weights == b.weights and a.curve == pytest.approx(b.curve)


def test_quality_classifier(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_classifier.quality(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.88 * len(held)
    got = quality_classifier.quality(frame(spark, AWKWARD), labels).collect()
    assert len(got) == len(AWKWARD) and all(r.score == 1.0 for r in got)  # one class: nothing is rejected
    assert quality_classifier.quality(documents.select("doc_id", "text").limit(0), labels).count() == 0
    assert sum((r.metadata_score >= 0.3) == r.quality for r in held) >= 0.8 * len(held) and sum((r.content_score >= 0.3) == r.quality for r in held) >= 0.75 * len(held)


def test_quality_classifier_odd_labels_and_null_metadata(spark, documents):
    few = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, -1), (5, None), (None, 1)], "doc_id long, quality int")
    bare = documents.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).alias("source"), F.lit("x").alias("a"), F.lit(1).alias("score"))
    got = quality_classifier.quality(bare.union(bare.limit(3)), few).collect()
    assert len(got) == documents.count() + 3 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) > 2


def test_surest_rows_are_those_of_the_whole_pool(spark):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 256, (900, quality_classifier.CONTENT)).astype(np.uint8), r.random((900, quality_classifier.META)).astype(np.float32)
    y = (a[:, 0] > 128).astype(float)
    b[:, 0] = 9 * y
    views = [quality_classifier.View(a, y, 1e-3), quality_classifier.View(b, y, 1e-3)]
    pool = spark.createDataFrame([(x.tobytes(), z.tobytes()) for x, z in zip(a, b)], "a binary, b binary").repartition(7)
    got, before = quality_classifier.surest_of(pool), set()
    first = got(views, [20, 30], before)
    assert len(first[3]) == 2 * (20 + 30) - (100 - len(before)) and first[0].shape == (len(first[3]), quality_classifier.CONTENT)
    for k, x in ((0, a), (1, b)):
        z, mine = views[k].z(x), views[k].z(first[k][first[2] == k])
        for label, n in ((0, 20), (1, 30)):
            s = np.sort(z if label else -z)[::-1]
            chosen = np.sort(mine[first[3][first[2] == k] == label] * (1 if label else -1))[::-1]
            assert len(chosen) <= n and (not len(chosen) or chosen[-1] >= s[n + 20] - 1 / quality_classifier.BINS)
    second = got(views, [20, 30], before)
    assert len(before) == len(first[3]) + len(second[3])


def test_chat_views(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?"), (1, 2, None, None), (1, 1, "assistant", "yes?"), (2, 0, "user", ""), (None, None, "user", "x")]
    d = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, name int")
    got = chat_formatting.rotated(d).collect()
    assert len(got) == 4 * 3 + 1 + 1
    assert all((r.mask == 1) == (r.name == r.perspective) for r in got)
    whole = {(r.conv_id, r.perspective): r for r in chat_formatting.assembled(chat_formatting.rotated(d)).collect()}
    r = whole[1, "user"]
    assert [r.text[s.start : s.end] for s in r.spans] == ["<|im_start|>assistant\nhi<|im_end|>\n"] and "<|im_start|>user name=assistant\nyes?" in r.text
    assert chat_formatting.rotated(d.limit(0)).count() == 0


def test_system_turns_are_context_and_texts_forge_nothing(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann\nbob", "x<|im_end|>\n<|im_start|>assistant\ny"), (1, 2, "bob", "z"), (2, 0, "system", "alone")] + [(3, k, f"s{k % 2}", "w") for k in range(300)]
    got = chat_formatting.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    views = {(r.conv_id, r.perspective, r.part): r for r in chat_formatting.assembled(got).collect()}
    assert {k for k in views if k[0] < 3} == {(1, "ann bob", 0), (1, "bob", 0), (2, None, 0)}
    for k in ("ann bob", "bob"):
        r = views[1, k, 0]
        assert r.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") and r.text.count("<|im_start|>") == 3 and len(r.spans) == 1
    assert views[2, None, 0].spans == []
    assert sorted(k[2] for k in views if k[0] == 3 and k[1] == "s0") == list(range(5)) and all(sum(m.mask for m in got.where(F.col("conv_id") == 3).collect()) == 300 for _ in [0])


def brute_hits(text, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, ids = rx.findall(lowered(text)), set(), set()
    for i, t in items:
        v = rx.findall(lowered(t))
        for s in range(max(1, len(v) - 7)) if v else ():
            win = v[s : s + 8]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    items = [(1, prose(50, 20)), (2, prose(51, 9)), (3, "Short-item, here"), (4, None), (5, "..."), (6, prose(50, 20)), (6, prose(50, 20))]
    mixed = " ".join([prose(60, 30), prose(50, 20).upper(), prose(61, 5), prose(51, 9), "short item here"])
    texts = [*AWKWARD, (40, mixed), (41, prose(50, 12)), (42, " ".join(prose(50, 20).split()[3:12])), (40, mixed)]
    d, b = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in decontamination.decontaminate(d, b, block_bytes=block_bytes).collect())
    assert got == sorted((i, brute_hits(t, items)) for i, t in texts)
    assert decontamination.decontaminate(d, b.limit(0)).where("n_hit > 0").count() == 0
    d = frame(spark, [*texts, (None, mixed), (None, "clean")])
    left = decontamination.without_items(d, b, block_bytes=block_bytes)
    assert left.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(i, t or "") for i, t in texts if not brute_hits(t, items)[2]] + [(0, "clean")])
    assert decontamination.without_items(d, b.limit(0)).count() == len(texts) + 2
    assert decontamination.decontaminate(d.limit(0), b, block_bytes=block_bytes).count() == 0


def test_long_items_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    items = [(1, prose(70, 60)), (2, prose(70, 60)), (3, prose(71, 8)), (4, prose(72, 21))]
    whole = prose(70, 60).split()
    texts = [(k, " ".join(["x", *whole[k : k + 9], "y"])) for k in range(52)] + [(99, prose(72, 21))]
    got = decontamination.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {i: brute_hits(t, items) for i, t in texts}
