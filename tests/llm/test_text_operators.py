"""Operators on texts against brute force and the libraries, with nulls, empty and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lagweave.llm import decontaminate, html_text, jaccard_join, language, licence_scan, pieces, substring_dedup, token_files
from lagweave.llm.shared import Sieve, components

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    """doc_id, text, and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], "doc_id long, text string, node string, keys long, items string").repartition(3)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "The cat sat on the mat. " * 9), (5, "The cat sat on the mat. " * 9), (5, "The cat sat on the mat. " * 9), (6, "a"), (7, "日本語 éà ß 😀 <|endoftext|> don't"), (8, "word " * 30_000), (9, "x" * 20_000)]


# --- shared ---


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] is not None and e[0] != e[1]}


def test_sieve_passes_all_keys(spark):
    keys = [int(x) for x in np.random.default_rng(0).integers(-(2**62), 2**62, 500)] + [0, -1, 32767, 32768]
    sieve = Sieve(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert sieve(np.array(keys)).all()
    assert sieve(np.random.default_rng(1).integers(-(2**62), 2**62, 5000)).mean() < 0.2


# --- op 1 ---


def test_simple_8b_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(120):
        n, w = rng.integers(0, 300), int(rng.choice([1, 3, 8, 16, 33, 62, 64]))
        ids = rng.integers(0, 2**64 - 1, n, dtype=np.uint64) >> np.uint64(64 - w)
        ids = ids >> rng.integers(0, w, n).astype(np.uint64)
        ends = np.sort(rng.integers(0, n + 1, 4))
        ends[-1] = n
        doc_ids, counts, back = token_files.read_block(token_files.block_bytes(np.arange(4), ids, ends))
        assert (back == ids).all() and (np.cumsum(counts) == ends).all() and doc_ids.tolist() == [0, 1, 2, 3]


def test_encoder_equals_library():
    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    alphabets = ["abc 'sll ve", "  \n\t a", "é ñ12 ½²", "<>!?.,;:'\" x", "日本 a", "word's don't I'll 'S", "×÷ a", " “”…€"]
    texts = [""] + ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    ids, ends = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark):
    rows = token_files.round_trip(frame(spark, ODD), public_tokenizers.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    library = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")).library
    start, expected = 0, []
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == expected
    assert token_files.round_trip(frame(spark, ODD).where("false"), public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_added_tokens_equal_a_fresh_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["end of a sample<|endoftext|>next", "<|endoftext|>", " <|endoftext|> <|endoftext|>\n", "<|endoftext", "plain", "日本<|endoftext|>", "a<|endoftext|>b " * 300]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in expected[0]
    ids, ends = token_files.Encoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == expected
    start, rows = 0, []
    for i, x in enumerate(expected):
        rows.append((i, start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        start += len(x) + 1
    got = token_files.round_trip(frame(spark, list(enumerate(texts))), path, 2).orderBy("start").collect()
    assert [tuple(r) for r in got] == rows


# --- op 2 ---


def test_html():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="no-sidebar"><header><p>Site</p></header><nav><a>Menu</a></nav>
    <article><header><h1>Head&nbsp;line</h1></header><p>One <b>two</b>&amp;three<br>four.<p>Five.<div class="ad"><p>Buy.</p></div><ul><li>a<li>b</ul>
    <aside>Side</aside><form>Mail<input></form><script>if (a<b) "</p>"</script><p>Last.</article><section id="comments"><p>Reader says.</p></section><footer>(c)</footer>"""
    assert html_text.main_text(page) == "Head line\n\nOne two&three four.\n\nFive.\n\na\n\nb\n\nLast."
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<nav>x</nav>")
    assert html_text.main_text("<div><p>A b c.</p><div class='cookie-notice'>x</div><p>D e f.</p></div>") == "A b c.\n\nD e f."


@pytest.mark.parametrize("page", [
    "<div class='content no-sidebar'>{}</div>", "<div id='page' class='with-sidebar'>{}</div>", "<div class='has-ads'>{}</div>", "<div class='page sidebar'><main>{}</main></div><p>Short.</p>",
    "<div class='banner'><article>{}</article></div><p>Some other text stands here, and it is longer than the article's is, as it happens, by some words, of which there are many more.</p>",
    "<div class='widget social'>{}</div>", "<html><head><meta charset=utf-8><title>no</title><body>{}", "<head><link rel=x><script>a</script>{}", "<section id='comments'>{}</section>"])
def test_html_misleading_wrappers(page):
    assert html_text.main_text(page.format("<h1>Title here</h1><p>The article's own text is a good deal longer.</p>")) == "Title here\n\nThe article's own text is a good deal longer."


def test_html_stretches():
    ads = "<div class='ad'>Buy</div>" * 3
    text = "<p>A long text of the page that is by far the longest here, so it is the best.</p>"
    body = "A long text of the page that is by far the longest here, so it is the best."
    assert html_text.main_text(f"<div class='entry-header'><h1>Own title</h1></div>{ads}{text}") == f"Own title\n\n{body}"
    for other in ("短い文です。", "यह एक वाक्य है।", "هل هذا نص؟"):
        assert html_text.main_text(f"<p>{other}</p>{ads}{text}") == f"{other}\n\n{body}"
    assert html_text.main_text(f"<p>x | y</p>{ads}{text}") == body
    assert html_text.main_text(f"{text}<section id='comments'><article><p>{'Readers say more. ' * 20}</p></article></section>") == body


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>a  b</p>"), (None, "u", "")], "page_id long, url string, html string")
    assert {tuple(r) for r in html_text.extracted(pages).collect()} == {(1, "u", "", 0), (2, None, "a b", 3), (None, "u", "", 0)}


# --- op 4 ---


def words4(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_decontaminate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(frame(spark, ODD).select("doc_id", "text"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "the of"), (901, "cat sat on"), (902, ""), (903, None), (None, "is"), (904, "word " * 12)], "item_id long, text string"))
    items = {r.item_id: words4(r.text) for r in bench.collect() if r.item_id is not None and words4(r.text)}
    windows = {}
    for i, w in items.items():
        m = min(8, len(w))
        for j in range(len(w) - m + 1):
            windows.setdefault(m, {}).setdefault(tuple(w[j : j + m]), set()).add(str(i))
    expected = []
    for r in docs.collect():
        w = words4(r.text)
        hit, found = [False] * len(w), set()
        for m, table in windows.items():
            for j in range(len(w) - m + 1):
                if got := table.get(tuple(w[j : j + m])):
                    found |= got
                    hit[j : j + m] = [True] * m
        expected.append((r.doc_id, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    for size in (1 << 20, 2000):  # one part, and several
        got = [tuple(r) for r in decontaminate.digest(decontaminate.marked(docs, bench, part_bytes=size)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))
    assert decontaminate.cleaned(docs, bench.where("false")).count() == docs.count()


def test_decontaminate_by_joins(spark):
    """A large benchmark is met by joins: copies, repeated rows, odd columns, and items that share windows."""
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [f"before {passage} after", f"{passage} {passage}", "w1 w2 w3 w4 w5 w6 w7", "short one", "", None, "clean text of no item at all, none"]
    rows = [(i, texts[i % len(texts)], i, "x", True) for i in range(400)] + [(None, texts[0], 1, "x", True), (0, texts[0], 0, "x", True), (0, texts[0], 0, "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, hits string, spans boolean")
    bench = spark.createDataFrame([(str(i), f"item {i} has {passage}") for i in range(60)] + [("s", "short one"), ("s", "short one"), ("n", None), (None, passage), ("e", ". ,")], "item_id string, text string")
    whole, cut = (sorted(map(str, decontaminate.marked(docs, bench, part_bytes=size, keep=True).collect())) for size in (1 << 24, 0))
    assert whole == cut and len(cut) == len(rows)
    digests = {r.doc_id: r for r in decontaminate.digest(decontaminate.marked(docs, bench, part_bytes=0)).collect()}
    assert [(digests[i].n_words, digests[i].n_hit, digests[i].n_items) for i in range(7)] == [(32, 30, 60), (60, 60, 60), (7, 0, 0), (2, 2, 1), (0, 0, 0), (0, 0, 0), (8, 0, 0)]
    assert decontaminate.marked(docs.where("false"), bench, part_bytes=0).count() == 0
    assert decontaminate.marked(docs, bench.where("false"), part_bytes=-1).count() == len(rows)


# --- op 5 ---


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[top(i)] = min(d, lowest.get(top(i), d))
    return [(d, len(sets[i]), lowest.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, k, percent):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(n)] for n in (60, 150, 14, 24)]
    rows = list(ODD)
    for i in range(160):
        w = list(base[i % 4])
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"X{r.randrange(9)}"
        rows.append((100 + i, " ".join(w)))
    got = jaccard_join.joined(frame(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows, k, percent)))


def test_frequent_items_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 1000, raising=False)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 64, raising=False)
    rows = [(i, f"in nearly all of them n{i} m{i} o{i}") for i in range(1200)] + [(2000 + i, "one text in many copies") for i in range(300)]
    docs = frame(spark, rows).selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    docs = docs.where("pmod(text_hash, 16) <> 0 or doc_id >= 2000")  # no text that one in 16 would show
    n = docs.where("doc_id < 2000").count()
    items = jaccard_join.shingle_sets(pa.array(["in nearly all of them", "one text in many copies"]), 3)[0]
    often = jaccard_join.frequent(docs, 3)(items)
    assert often.sum() == 3 and sorted(r.n for r in jaccard_join.counted(docs, 3).collect()) == [n] * 3


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(5)
    for size in [*range(1, 40), 90, 300]:
        a = np.sort(rng.integers(0, 2**64 - 1, size, dtype=np.uint64))
        for _ in range(12):
            keep = rng.permutation(a)[: size - rng.integers(0, size // 8 + 1)]
            b = np.sort(np.concatenate([keep, rng.integers(0, 2**64 - 1, rng.integers(0, size // 8 + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                keys, at = jaccard_join.set_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


# --- op 6 ---


def test_licences(spark):
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.licences for r in licence_scan.scanned(docs).collect()}
    assert got == {r.doc_id: [known[x] for x in r.text.split("\n") if x in known] for r in docs.collect()}
    assert any(got.values())
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    assert licence_scan.licences(licence_scan.identifiers(mit)) == ["MIT"]
    assert licence_scan.licences(licence_scan.identifiers("# SPDX-License-Identifier: BSD-3-Clause\nx = 1")) == ["BSD-3-Clause"]
    assert all(r.n_licences == 0 for r in licence_scan.scanned(frame(spark, ODD)).collect())


GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software Foundation, Inc."""
GRANT = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
ISC_AS_IS = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY.'
BSD = ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n", "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation.",
       "3. All advertising materials mentioning features or use of this software must\n   display the following acknowledgement:\n   This product includes software developed by X.", "4. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from\n   this software.", '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, ARE DISCLAIMED.']
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {} General Public\nLicense as published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version."
PUBLIC = [
    ("GPL-2.0-or-later", GPL.format(2), 4), ("GPL-3.0-or-later", GPL.format(3), 4), ("ISC", GRANT + ", provided that the above\ncopyright notice and this permission notice appear in all copies." + ISC_AS_IS, 2), ("0BSD", GRANT + "." + ISC_AS_IS, 2),
    ("BSD-4-Clause", "\n".join(BSD), 6), ("BSD-3-Clause", "\n".join(BSD[:3] + BSD[4:]), 5), ("BSD-2-Clause", "\n".join(BSD[:3] + BSD[5:]), 4), ("Apache-2.0", APACHE, 5),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", 2),
    ("LGPL-2.1", LGPL.format("Lesser", "2.1"), 1), ("LGPL-3.0", LGPL.format("Lesser", "3"), 1), ("AGPL-3.0", LGPL.format("Affero", "3"), 1),
    ("EPL-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available online.", 1), ("Unlicense", "This is free and unencumbered software released into the public\ndomain.", 1), ("CC0-1.0", "To the extent possible\nunder law, it is\ngiven under CC0 1.0.", 1),
]


@pytest.mark.parametrize(("licence", "text", "n"), PUBLIC, ids=[x for x, _, _ in PUBLIC])
def test_public_licence_texts(licence, text, n):
    for t in (text, "\n".join(" * " + x for x in text.split("\n")), "A first line without an end\n" + text):
        ids = licence_scan.identifiers(t)
        assert licence_scan.licences(ids) == [licence] and len(ids) == n, ids


def test_licence_parts():
    names = lambda t: licence_scan.licences(licence_scan.identifiers(t))
    assert names("Released under the MIT License; see the file.") == ["MIT"] == names("Copyright 2020 Foo\nReleased under the MIT License\nand more words")
    assert names("This program is licensed under the GNU General Public License, version 2\nor (at your option) any later version.") == ["GPL-2.0-or-later"]
    long = "a b\n" * 12 + "under the GNU General Public License as published; " + "c d\n" * 12 + "version 3 of the License, or any later version."
    assert names(long) == ["GPL-3.0-or-later"]
    assert names("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\nx = 1") == ["MIT", "Apache-2.0"]


# --- op 8 ---


def test_pieces_equal_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(4)
    alphabets = ["abcdefghij", "thesanreonio ", "a ", "ab", "éèaçñ üß", "<>0123456789x", "=-_*#/ \n", "日本語中文 кириллица", "▁ a"]
    texts = ["", " ", "  a  b ", "\x00a", "<s>hi</s>", "a" * 3001, " " * 100, *(t for _, t in ODD if t)]
    texts += ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    expected = library.encode(texts)
    assert [x.tolist() for x in own.encode(texts)] == expected
    ids, ends = own.encode_flat(pa.array(texts))
    assert own.decode_flat(ids, ends) == [library.decode(x) for x in expected]
    for _ in range(300):
        x = [r.choice([r.randrange(32000), r.randrange(300), 259, 28705]) for _ in range(r.randint(0, 6))]
        assert own.decode(x) == library.decode(x)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoded(frame(spark, ODD), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, t in ODD for x in [library.encode(t or "")]}


# --- op 9 ---


def test_substrings(spark):
    r = random.Random(6)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(7))
    lines = "\n".join(sentence(12) for _ in range(5))
    own = {i: [sentence(r.randint(8, 30)) for _ in range(6)] for i in range(20)}
    rows = []
    for i in range(12):
        parts = list(own[i])
        parts.insert(3, passage if i % 3 else lines)
        rows.append((i, (" " if i % 2 else "\n").join(parts)))
    rows += [(i, "\n".join(own[i])) for i in range(12, 20)] + [(50, "\n".join(["Short line of five words."] * 20)), (51, "Short line of five words.\n" + sentence(20))] + [(60 + i, t) for i, t in ODD[:3]]
    got = {x.doc_id: x for x in substring_dedup.deduplicated(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        repeated = 2 <= i < 12
        assert (got[i].n_removed > 0) == repeated, i
        if not repeated:
            assert got[i].text == t
        else:
            assert passage[80:300] not in got[i].text and lines not in got[i].text
            assert all(s in got[i].text for s in own[i])
    assert got[0].node == "x" and got[0].keys == 7


def test_passages_without_bounds(spark):
    r = random.Random(9)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    signs = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    p, q, hindi = words(50), signs(60), " ".join("".join(chr(r.randrange(0x915, 0x939)) for _ in range(5)) for _ in range(40))
    edited = [x if i % 29 else "new" for i, x in enumerate(p.split())]
    own = {x: (words(40), words(40)) for x in range(2, 12)}
    joins = {2: (p, " "), 3: (p, " "), 6: (hindi, " "), 7: (hindi, " "), 8: (words(29), " "), 9: (None, " ")}
    joins[9] = joins[8]
    rows = [(i, own[i][0] + sep + x + sep + own[i][1]) for i, (x, sep) in joins.items()]
    own |= {4: (signs(45), signs(45)), 5: (signs(45), signs(45))}
    rows += [(i, own[i][0] + q + own[i][1]) for i in (4, 5)]
    rows += [(20, own[10][0] + "\n\n" + "\n".join(" ".join(edited[i : i + 9]) for i in range(0, 50, 9)) + "\n\n" + own[11][0])]
    got = {x.doc_id: (x.text, x.n_removed) for x in substring_dedup.deduplicated(frame(spark, rows)).collect()}
    text = dict(rows)
    for i in (2, 4, 6, 8, 9):
        assert got[i] == (text[i], 0)
    assert got[3] == (" ".join(own[3]), 50) == (got[3][0], got[3][1])
    assert got[5] == ("".join(own[5]), 60) and got[7] == (" ".join(own[7]), 40)
    assert all(x in got[20][0] for x in (own[10][0], own[11][0])) and got[20][1] >= 48, got[20]


def test_near_paragraphs(spark):
    r = random.Random(8)
    w = [f"w{r.randrange(900)}" for _ in range(90)]
    near = list(w)
    near[40] = "changed"
    far = [x if i % 6 else "other" for i, x in enumerate(w)]
    rows = [(1, " ".join(w)), (2, "Own words here first\n" + " ".join(near)), (3, " ".join(far))]
    got = {x.doc_id: (x.text, x.n_removed) for x in substring_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == (rows[2][1], 0)
    assert got[2] == ("Own words here first\n", 90)


def test_bands():
    for percent in (70, 80, 90):
        b = substring_dedup.bands(percent)
        assert 1 - (1 - (percent / 100) ** substring_dedup.ROWS) ** b >= 0.9995


# --- op 10 ---


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = language.fit(docs)
    mixed = docs.where("lang = 'en'").first().text[:800] + "\n" + docs.where("lang = 'de'").first().text[:800]
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "„“ 😀 ½"), (5, mixed), (6, "日本")])
    got = {r.doc_id: r for r in language.predicted(odd, model, keep=True).collect()}
    assert [got[i]["__lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[1].node == "x"
    assert {k for k, v in got[5]["__languages"].items() if v > 0.2} == {"en", "de"}
    nothing = language.fit(docs.where("false"))
    assert {r["__lang_pred"] for r in language.predicted(odd, nothing).collect()} == {"und"}


def test_copies_count_once_in_the_model(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(80)) for _ in range(60)]
    once = spark.createDataFrame([(t, "x") for t in texts] + [("zz yy", "y")], "text string, lang string")
    copies = once.union(spark.createDataFrame([(t, "x") for t in texts[:30] for _ in range(20)], "text string, lang string"))
    for n in (10, 25):
        np.testing.assert_array_equal(language.fit(once, n).weights, language.fit(copies, n).weights)


def brute_mixture(like, rounds):
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        part = like * share
        share = (part / part.sum(1, keepdims=True)).mean(0)
    return share


def test_mixture_equals_plain_em():
    like = np.random.default_rng(0).random((40, 3))
    text = np.repeat([0, 1], [15, 25])
    share, _ = language.mixture(like, text, np.ones((2, 3)), 7)
    np.testing.assert_allclose(share, [brute_mixture(like[:15], 7), brute_mixture(like[15:], 7)])


# --- op 2: menus without names, depth ---


def test_html_menus_without_names():
    body = "<p>The first paragraph tells what happened on that day.</p><p>The second one goes on.</p>"
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/about>About</a></li><li><a href=/c>Contact us</a></li></ul>"
    text = "The first paragraph tells what happened on that day.\n\nThe second one goes on."
    assert html_text.main_text(menu + body) == html_text.main_text(body + menu) == html_text.main_text(f"<div>{menu}</div><div>{body}</div>") == text
    assert html_text.main_text(f"<h1><a href=/x>A title</a></h1>{body}") == "A title\n\n" + text
    linked = html_text.main_text(body + "<p><a href=/more>Only a link here</a></p>" + body)
    assert linked == text + "\n\nOnly a link here\n\n" + text
    assert html_text.main_text("<p><a href=1>One story</a></p><p><a href=2>Another story</a></p>") == "One story\n\nAnother story"


@pytest.mark.parametrize("tag", ["div", "b", "div class=promo", "a href=x"])
def test_html_deep_pages(tag):
    import time

    took = []
    for n in (25_000, 100_000):
        began = time.perf_counter()
        text = html_text.main_text(f"<{tag}>x" * n + f"</{tag.split()[0]}>" * n + "</p></b>" * n)
        took.append(time.perf_counter() - began)
        assert text.count("x") == (n if "class" not in tag else n // 2)  # what holds most of the text is no advert
    assert took[1] < 12 * took[0] + 1


def test_html_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>a b</p>" * 20_000, 5)], "page_id long, url string, html string, n_chars long")
    got = sorted((str(r.page_id), r.text.count("a b"), r.n_chars) for r in html_text.extracted(pages).collect())
    assert got == [("1", 0, 0), ("1", 0, 0), ("None", 20_000, 5 * 20_000 - 2)]
    assert html_text.extracted(pages.where("false")).count() == 0


def test_language_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 3, 4), (None, None, None, 3, 4)], "doc_id long, text string, lang string, `a.b` int, held_out int")
    model = language.fit(docs)
    told = language.predicted(docs, model, keep=True)
    assert told.columns[:5] == docs.columns and {(r["a.b"], r["held_out"]) for r in told.collect()} == {(3, 4)}
    assert language.predicted(docs.where("false"), model).count() == 0
    cut = substring_dedup.deduplicated(docs.withColumn("n_removed", language.F.lit("x")))
    assert cut.columns == [*docs.columns, "n_removed"] and {r.n_removed for r in cut.collect()} == {0}


# --- op 6: comments, one line, long sentences ---

#: Fixed value: the public licence text.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "-- "])
def test_licences_in_comments(mark):
    import textwrap

    for width in (25, 40, 72, 100):
        lines = "\n\n".join(textwrap.fill(x, width) for x in MIT.split("\n\n")).split("\n")
        assert licence_scan.licences(licence_scan.identifiers("\n".join(mark + x for x in lines))) == ["MIT"]
    assert licence_scan.licences(licence_scan.identifiers(mark + " ".join(MIT.split()))) == ["MIT"]


def test_licence_time_follows_length(spark):
    import time

    for text in ("gnu general public license ", "licensed under the mit license ; ", "copyright "):
        took = []
        for n in (2_000, 16_000):
            began = time.perf_counter()
            licence_scan.identifiers(text * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 20 * took[0] + 0.5, (text, took)
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, MIT, 1), (2, MIT, 1)], "doc_id long, text string, licences int")
    assert sorted((r.doc_id, tuple(r.licences)) for r in licence_scan.scanned(docs).collect()) == [(1, ())] * 2 + [(2, ("MIT",))] * 2
    assert licence_scan.scanned(docs.where("false")).count() == 0
