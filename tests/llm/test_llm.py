"""Operators of evalweave.llm against brute force, exact round trips, held-out accuracy and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from evalweave.llm import ann, byte_bpe, chat, common, ctw, decontaminate, licenses, minhash, quality, queries, token_file, warc
from evalweave.llm.tokens import ByteDecoder, read_ranks
from verify import TABLES, rows_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = ["", None, "a", "a  x", "a   x b   c", "  lead", "trail  \n\n", "don't I'll 've", "日本語 テスト 😀😀", "x" * 30_000, " \t \n a", "\x1c y\x85 z", "é é　　 q", "<|endoftext|> x<|startoftext|>", "İstanbul ΑΣ ς", "same text", "same text"]


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def docs(spark):
    return common.table(spark, SMALL, "documents")


def odd_docs(spark, clash=True):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1), (3, "a  x", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, vertex string, score int" if clash else "doc_id long, text string, a string, b int")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


# 1


def test_quality_held_out(spark):
    scored = quality.op1_quality(spark, SMALL.replace("0.001", "0.01"))
    labels = common.table(spark, SMALL.replace("0.001", "0.01"), "labels").select("doc_id", "quality")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_quality_at_every_size(spark, size):
    """Held-out AUC (score above, ties half), and texts without content, which are never good."""
    folder = SMALL.replace("0.001", size)
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    learned = common.crc_mod(F.col("doc_id"), 3) != 1
    model = quality.fit(docs, labels.where(learned))
    rows = docs.join(labels.where(~learned), "doc_id").select("text", "quality").collect()
    measure = model.measure()
    scores = model.scores(np.array([measure((r.text or "").encode()) for r in rows]))
    good, bad = scores[[r.quality == 1 for r in rows]], scores[[r.quality == 0 for r in rows]]
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.8
    assert (good >= 0.5).mean() > 0.7 and (bad >= 0.5).mean() < 0.1
    free = ["", "the", "und", "hello", "the " * 500, "buy " * 500, "und " * 300, "x" * 3000]
    assert (model.scores(np.array([measure(t.encode()) for t in free])) < 0.5).all()
    grid = model.scores(np.linspace(-1, 1, 201))
    assert (np.diff(grid) >= 0).all()


def test_quality_as_brute_force(spark, docs):
    """Differences by plain zstandard frames, scores by the written-out curve, held-out texts by dictionaries without them, and the curve by its own optimum."""
    import zstandard

    labels = common.table(spark, SMALL, "labels")
    model = quality.fit(docs, labels)
    assert len(model.pairs) == quality.FOLDS

    def plain(t, pair):
        sizes = []
        for raw in pair:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=quality.LEVEL)
            c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(t[i : i + quality.BLOCK_BYTES])) for i in range(0, len(t), quality.BLOCK_BYTES)))
        blocks = -(-len(t) // quality.BLOCK_BYTES)
        more = sizes[1] - sizes[0]
        more -= max(-quality.NOISE_BYTES * blocks, min(quality.NOISE_BYTES * blocks, more))
        return more / math.sqrt((len(t) + 64) * (sum(sizes) - 2 * blocks * quality.FRAME_BYTES + 64))

    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.score(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model).collect():
        assert math.isclose(r.difference, sum(plain(texts[r.doc_id], p) for p in model.pairs) / 3, abs_tol=1e-9)
        z = r.difference / model.spread
        assert math.isclose(r.score, 1 / (1 + math.exp(-(z * (model.up if z > 0 else model.down) + model.foot))), rel_tol=1e-9)
    by_class = {q: [f"{q} {i} some words".encode() * (i + 5) for i in range(7)] for q in (0, 1)}
    pairs, differences, qualities = quality.held_out(by_class, 3)
    want = [(plain(t, pairs[f]), q) for f in range(3) for q in (0, 1) for t in by_class[q][f::3]]
    assert np.allclose(differences, [d for d, _ in want]) and qualities.tolist() == [q for _, q in want]
    assert [quality.pair_of({q: [t for i, t in enumerate(ts) if i % 3 != f] for q, ts in by_class.items()}) for f in range(3)] == pairs
    rng = np.random.default_rng(0)
    for true_foot, true_up in ((-1, 2), (1, 2), (-1, -2)):
        x = rng.normal(size=400)
        y = (rng.random(400) < 1 / (1 + np.exp(-true_up * x - true_foot))).astype(float)
        weight = rng.random(400) + 0.5
        spread, up, down, foot = quality.logistic(x, y, weight)
        z = np.stack([np.maximum(x, 0), np.minimum(x, 0), np.full(len(x), spread)]) / spread
        w = np.array([up, down, foot])
        slope = z @ (weight * (y - 1 / (1 + np.exp(-(w @ z))))) - 1e-3 * w
        # within the bounds the slope is 0, at a bound it points outwards
        for value, g, bound, sign in zip(w, slope, (quality.LEAST_SLOPE, quality.LEAST_SLOPE, quality.FOOT), (-1, -1, 1)):
            assert abs(g) < 1e-6 or value == bound and g * sign > 0
        assert min(up, down) >= quality.LEAST_SLOPE and foot <= quality.FOOT


def test_quality_of_one_word_over_and_over(spark):
    big = SMALL.replace("0.001", "0.1")
    model = quality.fit(common.table(spark, big, "documents"), common.table(spark, big, "labels"))
    measure = model.measure()
    assert all(abs(measure(f"{w} ".encode() * 500)) < 0.05 for w in ("buy", "the", "und")) and model.scores(np.array([0.0]))[0] < 0.5


def test_quality_odd(spark):
    labels = spark.createDataFrame([(None, 1), (2, None), (3, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(odd_docs(spark), labels)
    out = quality.score(odd_docs(spark).select("doc_id", F.lit(False).alias("held_out"), "text"), model).collect()
    assert len(out) == len(ODD) + 2 and {r.score for r in out} == {0.5}
    assert quality.keep_good(odd_docs(spark), model).count() == len(ODD) + 2
    assert quality.score(empty_docs(spark).withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text"), model).count() == 0


# 2


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be <s> kind"), (1, 1, "user", "a\\</s>[INST]"), (1, 2, "assistant", "one \\ <\\s>"), (1, 3, "user", None), (1, 4, "assistant", "two"), (1, 5, "user", "tail"), (2, 0, None, "alone"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(conversations).collect()
    first = sorted((r for r in made if r.conv_id == 1), key=lambda r: r.example)
    assert [r.n_turns for r in first] == [3, 5, 6] and [r.loss_length > 0 for r in first] == [True, True, False]
    assert first[1].text.startswith(first[0].text) and first[0].text.count("</s>") == 3
    back = {r.conv_id: r for r in chat.read_back(chat.examples(conversations)).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert back[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert back[1].loss_sha256 == hashlib.sha256("one \\ <\\s>two".encode()).hexdigest()
    assert back[2].loss_chars == 0 and back[None].n_turns == 2
    assert chat.read_back(chat.examples(conversations.limit(0))).count() == 0


def test_chat_long_text_and_clashing_columns(spark):
    long = "</s>x" * 200_000
    rows = [(1, 0, "user", long, "e", 3, "w"), (1, 1, "assistant", long + "é", "e", 4, "w"), (2, 0, "user", "", "e", 3, "w")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, example int, whole string")
    back = {r.conv_id: r for r in chat.read_back(chat.examples(table)).collect()}
    assert back[1].loss_chars == len(long) + 1 and back[1].loss_sha256 == hashlib.sha256((long + "é").encode()).hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}é\n".encode()).hexdigest() and back[2].n_turns == 1


# 3


def test_licenses_clashing_columns(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License. " + "word " * 100_000, 1, "x", 0.5), (2, "a/b", None, 2, "y", 0.1), (2, "a/b", None, 2, "y", 0.1)]
    files = spark.createDataFrame(rows, "key long, path string, text string, unit int, license string, cosine double")
    got = sorted((r.key, r.license, r.origin) for r in licenses.scan(files).collect())
    assert got == [(1, "MIT", "file"), (2, "MIT", "inherited"), (2, "MIT", "inherited")]


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "nothing here"),
        (3, "a/b/y.py", "Some code. Licensed under the Apache License, Version 2.0. More code"),
        (4, "z/q.py", "all of the rights of the version of the work"),
        (5, None, None),
        (6, "top.py", ""),
        (7, "a/b/COPYING.txt", "no license at all"),
    ]
    files = spark.createDataFrame(rows, "key long, path string, text string")
    got = {r.key: r for r in licenses.scan(files).collect()}
    assert (got[1].license, got[1].origin) == ("MIT", "file")
    assert (got[2].license, got[2].origin, got[2].source_dir, got[2].levels) == ("MIT", "inherited", "a", 2)
    assert (got[3].license, got[3].origin) == ("Apache-2.0", "header")
    assert got[4].license is None and got[5].license is None and got[6].license is None and got[7].license == "MIT"
    assert licenses.scan(files.limit(0)).count() == 0


def test_wrapped_statements(spark):
    bsd = "/*\n * Copyright\n *\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n *\n * more\n */\nint x;"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os"
    rows = [(1, "a/x.c", bsd), (2, "b/y.py", gpl), (3, "c/z.py", gpl.replace("GNU General", "GNU Affero General")), (4, "d/w.c", "one line\nanother\n\nlast line")]
    got = {r.key: r.license for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: "GPL-3.0-or-later", 3: "AGPL-3.0-or-later", 4: None}


FULL_BSD = """Copyright (c) 2020, Someone
All other words are theirs.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
FOURTH = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software.
"""
GNU = "This {} is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation{} {}version {} of the License{}.\n"
LATER = ", or\n(at your option) any later version"
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so{}\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
PUBLIC = [
    ("BSD-2-Clause", FULL_BSD.format("")),
    ("BSD-3-Clause", FULL_BSD.format(THIRD)),
    ("BSD-4-Clause", FULL_BSD.format(FOURTH + THIRD)),
    ("0BSD", ISC_GRANT + '.\n\nTHE SOFTWARE IS PROVIDED "AS IS".'),
    ("ISC", ISC_GRANT + ', provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS".'),
    ("MIT", MIT_GRANT.format(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.")),
    ("MIT-0", MIT_GRANT.format(".")),
    ("GPL-2.0-or-later", GNU.format("program", ";", "General Public License", ";", "either ", "2", LATER)),
    ("GPL-2.0-only", GNU.format("program", ";", "General Public License", ";", "", "2", "")),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n"),
    ("GPL-3.0-or-later", GNU.format("program", ":", "General Public License", ",", "either ", "3", LATER)),
    ("GPL-3.0-only", GNU.format("program", ":", "General Public License", ",", "", "3", "")),
    ("AGPL-3.0-or-later", GNU.format("program", ":", "Affero General Public License", ",", "either ", "3", LATER)),
    ("LGPL-2.1-or-later", GNU.format("library", ";", "Lesser General Public License", ";", "either ", "2.1", LATER)),
    ("LGPL-2.1-only", GNU.format("library", ";", "Lesser General Public License", ";", "", "2.1", "")),
    ("LGPL-3.0-or-later", GNU.format("library", ":", "Lesser General Public License", ";", "either ", "3", LATER)),
    ("LGPL-3.0-or-later", GNU.format("program", ":", "Lesser General Public License", ",", "either ", "3", LATER)),
    ("LGPL-3.0-only", GNU.format("library", ";", "Lesser General Public License", ";", "", "3", "")),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 A Foundation\n Everyone is permitted to copy"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 A Foundation"),
    ("LGPL-2.1", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright"),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use"),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)"),
]


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_public_licenses_by_name(spark, docs, mark):
    """Each public header and text, plain and as a comment, among other documents; and as a license file as a whole."""
    lines = lambda t: "\n".join((mark + x).rstrip() for x in t.split("\n"))
    rows = [(10_000 + i, f"d{i}/x.c", lines(t)) for i, (_, t) in enumerate(PUBLIC)] + [(20_000 + i, f"e{i}/LICENSE", lines(t)) for i, (_, t) in enumerate(PUBLIC)]
    others = docs.select(F.col("doc_id").alias("key"), F.concat(F.lit("o/"), F.col("doc_id").cast("string")).alias("path"), "text")
    got = {r.key: (r.license, r.origin) for r in licenses.scan(others.unionByName(spark.createDataFrame(rows, "key long, path string, text string"))).collect()}
    wrong = [(name, got[k + i][0]) for k in (10_000, 20_000) for i, (name, _) in enumerate(PUBLIC) if got[k + i][0] != name]
    assert not wrong


def test_full_texts_as_whole_files(spark, docs):
    """A license file that has the words of a full text, run together with others, is known as a whole."""
    rows = [(10_000 + i, f"e{i}/LICENSE", f"{t.text.replace('. ', ' ')} copyright holder 2020 and so on") for i, t in enumerate(licenses.TEMPLATES) if len(t.text) > 600]
    others = docs.select(F.col("doc_id").alias("key"), F.lit("o/x").alias("path"), "text")
    got = {r.key: r.license for r in licenses.scan(others.unionByName(spark.createDataFrame(rows, "key long, path string, text string"))).collect()}
    assert len(rows) >= 6 and {k: got[k] for k, _, _ in rows} == {k: licenses.TEMPLATES[k - 10_000].license for k, _, _ in rows}


def test_anchors_lose_nothing():
    rng = np.random.default_rng(0)
    vectors = [{f"t{i}": float(x) for i, x in enumerate(rng.random(8))} for _ in range(20)]
    first = set(licenses.anchors(vectors, 0.75))
    for v in vectors:
        rest = math.sqrt(sum(x * x for t, x in v.items() if t not in first))
        assert rest < 0.75 * math.sqrt(sum(x * x for x in v.values()))


# 4


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://x/\r\na", "same"), (1, "http://y", "same"), (2, None, None), (4, "http://z", ""), (5, "u", "other é"), (5, "u", "other é"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == sorted([(3, 4, "revisit", 1), (1, 4, "response", None), (2, 0, "response", None), (4, 0, "revisit", 2), (5, 8, "response", None), (5, 8, "revisit", 5), (-1, 4, "revisit", 1)], key=str)
    whole = [bytes(r.record) for r in warc.records(spark, str(tmp_path / "a")).collect()]
    assert len(whole) == 7 and all(w.startswith(b"WARC/1.1\r\n") and w.endswith(b"\r\n\r\n") for w in whole)
    import base64

    digest = base64.b32encode(hashlib.sha1("other é".encode()).digest()).decode()
    assert sum(f"WARC-Payload-Digest: sha1:{digest}\r\n".encode() in w for w in whole) == 2
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3
    warc.write_archive(pages, str(tmp_path / "b"), least_bytes=5)
    assert {(r.page_id, r.record_type) for r in warc.read_archive(spark, str(tmp_path / "b")).where("payload_bytes = 4").collect()} == {(3, "response"), (1, "response"), (None, "response")}


def test_records_are_exact_bytes(spark, tmp_path):
    """Every reconstructed record against one written by hand."""
    import base64

    long = "é\r\n\r\n" + "x" * 300_000
    rows = [(1, "u1", long), (2, "u2", long), (3, None, ""), (4, "u4", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "page_id long, url string, html string, header string, copy int, sha256 string")
    warc.write_archive(pages, str(tmp_path / "a"))

    def name(page, url):
        h = hashlib.sha1(f"{page}\n{'null' if url is None else url}\n1".encode()).hexdigest()
        return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"

    want = []
    for page, url, text in rows:
        revisit, raw = page == 2, text.encode()
        lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page, url)}", f"WARC-Date: {warc.DATE}", url and f"WARC-Target-URI: {url}", f"WARC-Page-ID: {page}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(raw).digest()).decode()}"]
        lines += [f"WARC-Profile: {warc.PROFILE}", f"WARC-Refers-To: {name(1, 'u1')}", "WARC-Refers-To-Target-URI: u1", "WARC-Refers-To-Page-ID: 1"] if revisit else []
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(raw)}"]
        want.append("\r\n".join(x for x in lines if x).encode() + b"\r\n\r\n" + (b"" if revisit else raw) + b"\r\n\r\n")
    assert sorted(bytes(r.record) for r in warc.records(spark, str(tmp_path / "a")).collect()) == sorted(want)
    got = {r.page_id: r.payload_bytes for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert got == {page: len(text.encode()) for page, _, text in rows}


def test_damaged_payload_is_an_error(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit("y").cast("binary"))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


# 5


def test_token_file(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(P.path(token_file.VOCABULARY))
    for name, table in (("odd", odd_docs(spark)), ("docs", docs)):
        token_file.write_token_file(table, str(tmp_path / name))
        start = 0
        rows = token_file.read_token_file(spark, str(tmp_path / name)).orderBy("start").collect()
        want = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r.doc_id for r in rows] == [d for d, _ in want]
        for r, (_, text) in zip(rows, want):
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())) and list(r.ids) == ids.tolist()
            start += len(ids)
    token_file.write_token_file(empty_docs(spark), str(tmp_path / "empty"))
    assert token_file.read_token_file(spark, str(tmp_path / "empty")).count() == 0


def test_packing():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    counts = np.array([3, 0, 5])
    control, data, n_control, n_data = token_file.pack(ranks, counts)
    assert n_control.tolist() == [1, 0, 2] and n_data.sum() == len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1
    assert token_file.unpack(control, data, counts).tolist() == ranks.tolist()


# 6


def brute(x, ids, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k] if np.isfinite(s[i])]
    return out


def test_ann_exact_where_tuned_to_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "RECALL", 1.0)
    x = np.random.default_rng(5).normal(size=(120, 8)) * np.random.default_rng(6).random((120, 1)) * 3
    x[30:60] = x[30]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(500, None, "c"), (501, [0.0] * 8, "c"), (502, [float("nan")] * 8, "c"), (503, [1.0] * 5, "c"), (None, [1.0] * 8, "c"), (7, x[7].tolist(), "c"), (504, [None] + [1.0] * 7, "c")]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(x, np.arange(120))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("n, cell, block", [(3000, 64, 50), (1500, 8192, 1024), (2600, 512, 7)])
def test_ann_recall(spark, monkeypatch, n, cell, block):
    monkeypatch.setattr(ann, "CELL_ROWS", cell)
    monkeypatch.setattr(ann, "QUERY_ROWS", block)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, 16))
    found = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == ann.exact(x[[r.vec_id]], x[[r.query_id]])[0]
    want = brute(x, np.arange(n))
    assert np.mean([len(got[q] & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9


# 7


def test_ctw_counts_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()] + list(enumerate(ODD[:12], 10_000)) + [(None, "no id")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    got = {(r.doc_id, r.n_bytes): r for r in ctw.score(table.select("doc_id", (common.crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "text")).collect()}
    counts, ends = Counter(), 0
    for i, text in rows:
        if not held(i):
            counts.update(words(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, text in rows:
        r, w = got[i, len((text or "").encode())], words(text)
        base = sum(math.log10(counts[x] + 0.5) for x in w) + math.log10(ends + 0.5) - (len(w) + 1) * math.log10(n + 0.5 * (v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
    none = ctw.score(table.select("doc_id", F.lit(True).alias("held_out"), "text")).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in none)
    assert ctw.score(empty_docs(spark).select("doc_id", F.lit(True).alias("held_out"), "text")).count() == 0


def tree_bits(train, text, depth):
    """Textbook recursion over the same trees, node by node."""
    counts = {}
    for t in train:
        padded = b"\xff" * depth + t + b"\xff"
        for p in range(depth, len(padded)):
            for j in range(8):
                v, bit = (1 << j) | (padded[p] >> (8 - j)), (padded[p] >> (7 - j)) & 1
                for d in range(depth + 1):
                    counts.setdefault((padded[p - d : p], v), [0, 0])[bit] += 1
    children = {}
    for c, v in counts:
        if c:
            children.setdefault((c[1:], v), []).append((c, v))

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            if len(node[0]) == depth:
                memo[node] = (own, own, None)
            else:
                below = sum(weighted(c)[0] for c in children[node])
                top = max(own, below)
                memo[node] = (top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top)), own, below)
        return memo[node]

    total, padded = 0.0, b"\xff" * depth + text + b"\xff"
    for p in range(depth, len(padded)):
        for j in range(8):
            v, bit = (1 << j) | (padded[p] >> (8 - j)), (padded[p] >> (7 - j)) & 1
            path = [(padded[p - d : p], v) for d in range(depth + 1)]
            path = [x for x in path if x in counts]
            if not path:
                total += 1
                continue
            prob = None
            for node in reversed(path):
                one = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                if prob is None:
                    prob = one
                else:
                    _, own, below = weighted(node)
                    share = 1 / (1 + math.exp(min(700, below - own)))
                    prob = share * one + (1 - share) * prob
            total -= math.log2(prob if bit else 1 - prob)
    return total


@pytest.mark.parametrize("buckets", [4, 97])
def test_ctw_equals_recursion(spark, monkeypatch, buckets):
    """The whole path over buckets, joined upper levels and answers against node by node recursion."""
    monkeypatch.setattr(ctw, "shuffle_partitions", lambda _: buckets)
    train = [b"abracadabra abra", b"cadabra cad", "é ab".encode(), b"", b"abra abra"]
    other = [b"abra", b"", b"zzz cad", "né".encode(), train[0], b"abracadabra"]
    rows = [(i, i >= len(train), t.decode()) for i, t in enumerate(train + other)]
    for depth in (3, 6):
        got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), depth).collect()}
        for i, _, text in rows:
            assert math.isclose(-got[i] / math.log10(2), tree_bits(train, text.encode(), depth), rel_tol=1e-5)


def test_ctw_clashing_columns(spark):
    rows = [(i, i % 2 == 0, t, b"x", 5, [1]) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string, keys binary, bucket int, answers array<int>")
    assert ctw.score(table.limit(0)).count() == 0 and ctw.score(table).count() == len(ODD)


# 8


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_groups(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(6):
        text = list(rng.choice(vocabulary, 120))
        for copy in range(40 if base == 0 else 4):
            t = list(text)
            for at in rng.integers(0, 120, int(rng.integers(0, 9))):
                t[at] = str(rng.choice(vocabulary))
            rows.append((len(rows) * 3 + 1, " ".join(t)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width, monkeypatch):
    monkeypatch.setattr(minhash, "SET_BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HELD_KEYS", 0 if width == 2 else 1 << 20)
    rows = near_copies() + [(900 + i, t) for i, t in enumerate(ODD)]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, label string, u int"), width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_groups(rows, width))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_family_and_outsiders(spark, monkeypatch):
    """One family far over all block sizes, with members that share its keys but not its links, against brute force."""
    monkeypatch.setattr(minhash, "SET_BLOCK", 64)
    monkeypatch.setattr(minhash, "BLOCK", 128)
    rng = np.random.default_rng(12)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    base, far = rng.choice(vocabulary, 100), rng.choice(vocabulary, 60)
    rows = []
    for i in range(1500):
        t = base.copy()
        if i % 5 == 1:  # parts of the family that lose their links one by one
            t[: int(rng.integers(8, 60))] = rng.choice(vocabulary)
        if i % 7 == 2:
            t[40:] = far
        for at in rng.integers(0, 100, int(rng.integers(0, 7))):
            t[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(t)))
    names = {s: k for k, s in enumerate({s for _, t in rows for s in shingles(t, 2)})}
    held = np.zeros((len(rows), len(names)), np.float32)
    for i, (_, t) in enumerate(rows):
        held[i, [names[s] for s in shingles(t, 2)]] = 1
    common_, size = held @ held.T, held.sum(1)
    linked = 100 * common_ >= 80 * (size[:, None] + size - common_)
    label = np.arange(len(rows))
    while True:
        least = np.where(linked, label, len(rows)).min(1)
        if (least == label).all():
            break
        label = least
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert len(set(label.tolist())) > 20 and {r.doc_id: r.component_id for r in got} == dict(enumerate(label.tolist()))


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (9, c), (9, c)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert sorted((r.doc_id, r.text_key, r.component_id) for r in got) == sorted([(2, md5(a), 2), (5, md5(a), 2), (5, md5(b), 5), (9, md5(c), 9), (9, md5(c), 9)])


def test_near_duplicates_odd(spark):
    got = minhash.near_duplicates(odd_docs(spark), width=2).collect()
    assert len(got) == len(ODD) + 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_keys_guarantee():
    """All signatures within the guaranteed distance share a key."""
    signer, rng = minhash.Signer(14, 6), np.random.default_rng(9)
    a = rng.integers(0, 1 << 16, (300, 84)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(84, 27, replace=False)
        row[at] ^= np.uint16(1)
    assert all(np.intersect1d(x, y).size for x, y in zip(signer.keys(a), signer.keys(b)))


# 9


def test_byte_bpe(spark, docs):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(byte_bpe.RANKS)), special_tokens={})
    for table in (odd_docs(spark), docs):
        want = Counter()
        for r in table.collect():
            ids = encoding.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in byte_bpe.digests(table).collect()) == want
    for r in byte_bpe.encode_decode(odd_docs(spark)).collect():
        raw = r.decoded.encode()
        assert all(encoding.decode_single_token_bytes(i) == raw[a:b] for i, a, b in zip(r.ids, r.byte_start, r.byte_end))
    assert byte_bpe.digests(empty_docs(spark)).count() == 0


def test_split_characters():
    decoder = ByteDecoder({0: b"\xf0\x9f", 1: b"\x98\x80", 2: b"a", 3: b"\xff"})
    assert decoder.pieces([0, 1, 2]) == ["", "😀", "a"] and decoder.pieces([2, 0]) == ["a", "�"] and decoder.pieces([3]) == ["�"]


# 10


def test_leaks(spark, docs, duck):
    fold = lambda s: " " + re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", s.lower()).strip() + " "
    items = {i: fold(t) for i, t in duck.execute("select item_id, text from benchmark").fetchall()}
    want = {(d, i) for d, t in duck.execute("select doc_id, text from documents").fetchall() for i, x in items.items() if x in fold(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, common.table(spark, SMALL, "benchmark")).collect()}
    assert want and got == want


def test_paraphrases_and_odd(spark, docs):
    items = common.table(spark, SMALL, "benchmark").limit(5).collect()
    w = items[0].text.split()
    near = " ".join(x if i % 9 else "changed" for i, x in enumerate(w))
    rows = [(1_000_000, "before it " + near + " and after"), (1_000_001, " ".join(w[: len(w) // 4])), (None, items[1].text), (1_000_002, None), (1_000_003, "")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(r.item_id, r.text) for r in items] + [(None, "x y z"), (77, None), (78, "!!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(more, bench).where("doc_id >= 1000000 or doc_id is null").collect()}
    assert got == {(1_000_000, items[0].item_id)}
    assert decontaminate.leaks(empty_docs(spark), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_paraphrases_against_brute_force(spark, docs):
    """Items with words replaced, left out and swapped, inside texts of the corpus; what plain LCS confirms is to be found."""
    rng = np.random.default_rng(21)
    items = [(r.item_id, r.text) for r in common.table(spark, SMALL, "benchmark").orderBy("item_id").collect() if len(r.text.split()) >= 12][:25]
    plain = [r.text.split()[:60] for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) >= 60]
    rows = []
    for k, (item, text) in enumerate(items * 6):
        w = decontaminate.terms_of(pa.array([text]))[0].to_pylist()
        w = [x.decode() for x in w]
        keep = rng.random(len(w)) >= rng.uniform(0.05, 0.3)
        near = [x if yes else (f"q{k}x{i}" if i % 2 else None) for i, (x, yes) in enumerate(zip(w, keep))]
        before = plain[k % len(plain)]
        rows.append((10_000_000 + k, " ".join(before[:30] + [x for x in near if x] + before[30:])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    cut = lambda t: [x.decode() for x in decontaminate.terms_of(pa.array([t]))[0].to_pylist()]
    bench = [(i, cut(t)) for i, t in items]
    for doc, text in rows:
        words_ = cut(text)
        for item, w in bench:
            if max(longest_common(w, words_[at : at + 2 * len(w)]) for at in range(0, max(1, len(words_) - len(w)), 4)) >= decontaminate.SURE * len(w):
                want.add((doc, item))
    assert len(want) > 60 and len(want & got) >= 0.97 * len(want)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    """Rows and values for blocks of 8 items are those of one block; texts are read once, whatever their number."""
    docs, bench = (common.table(spark, SMALL.replace("0.001", "0.01"), name) for name in ("documents", "benchmark"))
    found = {}
    for items in (decontaminate.ITEMS, 8):
        monkeypatch.setattr(decontaminate, "ITEMS", items)
        read = []
        whole = decontaminate.sequences
        monkeypatch.setattr(decontaminate, "sequences", lambda *a, whole=whole, read=read: (read.append(1), whole(*a))[1])
        found[items] = {(r.doc_id, r.item_id): (r.cosine, r.lcs_share) for r in decontaminate.leaks(docs, bench).collect()}
        assert len(read) == 1
        monkeypatch.setattr(decontaminate, "sequences", whole)
    one, many = found.values()
    assert one.keys() == many.keys() and len(one) > 20
    assert all(math.isclose(a, b, abs_tol=2e-5) for k in one for a, b in zip(one[k], many[k]))


def test_answers_confirm_weaker_paraphrases(spark, docs):
    """Paraphrases of 60 to 80 % of an item's words count where enough of its answer is there, by brute-force subsequences: at least 0.9 of them are found, and those without the answer are not."""
    rng = np.random.default_rng(22)
    items = [(r.item_id, r.text) for r in common.table(spark, SMALL, "benchmark").orderBy("item_id").collect() if len(r.text.split()) >= 15][:30]
    cut = lambda t: [x.decode() for x in decontaminate.terms_of(pa.array([t]))[0].to_pylist()]
    bench = [(i, t, f"answer{i}a answer{i}b answer{i}c") for i, t in items]
    plain = [r.text.split()[:60] for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) >= 60]
    rows, want, refused = [], set(), set()
    for k, (item, text, answer) in enumerate(bench * 6):
        w = cut(text)
        kept = rng.permutation(len(w))[: math.ceil(rng.uniform(0.62, 0.78) * len(w))]
        near = [x if i in set(kept.tolist()) else f"q{k}x{i}" for i, x in enumerate(w)]
        # the answer stands in the middle of some, and nowhere in others
        told = answer.split()[: 2 + k % 2] if k % 3 else []
        near[len(near) // 2 : len(near) // 2] = told
        before = plain[k % len(plain)]
        rows.append((10_000_000 + k, " ".join(before[:30] + near + before[30:])))
        share = longest_common(w, near) / len(w)
        if decontaminate.LIKELY <= share < decontaminate.SURE:
            (want if len(told) / 3 >= decontaminate.ANSWERED else refused).add((10_000_000 + k, item))
    table = spark.createDataFrame(bench, "item_id long, text string, answer string")
    found = decontaminate.leaks(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), table)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want) > 60 and len(refused) > 30
    assert len(want & got) >= 0.9 * len(want)
    # words that are left in their places may reach SURE with words of the text around them, but seldom
    assert len(refused & got) <= 0.1 * len(refused)


@pytest.mark.parametrize("share", [1, 2, 10, 100])
def test_leaks_whatever_their_number(spark, docs, share):
    plain = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.text][:200]
    item = "a passage that is told here in some rare words of zanzibar quokka and other things besides them all"
    rows = [(i, f"{t[:300]} {item} {t[300:]}" if k < share else t) for k, (i, t) in enumerate(plain)]
    got = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i for k, (i, _) in enumerate(rows) if k < share}


def test_leaks_by_text_key(spark):
    item = "which of the two rivers that run to the sea is the longer one and why is that so"
    rows = [("k1", "before " + item + " after"), ("k2", "nothing of the kind"), (None, item)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"), id_type="string")
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [("k1", 5)]


def test_leaks_of_common_terms(spark):
    shared = "which of the two rivers that run to the sea is the longer one and why is that so"
    common = "the of and to in a is that it for on was as with the of to and"
    rows = [(i, f"word{i} text{i} {shared} end{i}") for i in range(60)] + [(100 + i, " ".join(f"{w} x{i}y{k}" for k, w in enumerate(common.split()))) for i in range(60)]
    rows += [(200, "start of it " + common + " end of it"), (201, "no match here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, shared), (2, common), (3, "only word")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert {(d, i) for d, i in got if i == 1} == {(i, 1) for i in range(60)}
    assert (200, 2) in got and 201 not in {d for d, _ in got}
    two = docs.where("doc_id < 2")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(two, bench.where("item_id = 1")).collect()} == {(0, 1), (1, 1)}


def test_runs_as_brute_force():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 40, n).astype(np.int32) for n in (1, 2, 5, 14, 15, 16, 33, 59)]
    runs = decontaminate.Runs(items, 40)
    for i, item in enumerate(items):
        for left_out in range(len(item) - math.ceil(decontaminate.SURE * len(item)) + 1):
            kept = np.delete(item, rng.choice(len(item), left_out, replace=False))
            before = rng.integers(-1, 40, 50).astype(np.int32)
            terms, starts = np.concatenate([before, before, kept, before]), np.array([0, 50, 100 + len(kept) + 50])
            found = [m for r, j, m in runs.places(terms, starts) if (r, j) == (1, i)]
            assert found and any(abs(x - 100 - len(item) / 2) <= decontaminate.STEP / 2 + left_out for x in found[0])


def test_repeated_words_drown_nothing():
    rng = np.random.default_rng(5)
    item = rng.permutation(np.arange(1, 16)).astype(np.int32)
    terms = np.concatenate([np.zeros(40, np.int32), item, np.zeros(40, np.int32)])
    starts, weights = np.array([0, len(terms)]), np.ones(16)
    passages = np.array([0, -(-len(terms) // decontaminate.STEP)])
    found, passage = decontaminate.weighted(terms, weights, starts, passages)
    assert len(set(zip(found.tolist(), passage.tolist()))) == len(found)
    assert sorted(found[(passage >= 2) & (passage < 4)].tolist()) == [0, 0, *range(1, 16)]
    assert [(r, i) for r, i, _ in decontaminate.Runs([item], 16).places(terms, starts)] == [(0, 0)]


# pipeline


def test_pipeline(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "byte_bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = common.written(stage(spark, kept, SMALL), name)
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.collect()}
        if name == "near_duplicates":
            assert after == {d for d, _, c in brute_groups(sorted(before.items()), 5) if d == c}
        assert 0.6 * len(before) < len(after) < len(before)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(after)


def test_pipeline_knows_rows_by_id_and_text(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    item = " ".join(f"z{i}" for i in range(20))
    rows = [(2, a, "s"), (5, a, "s"), (5, b, "s"), (9, c, "s"), (9, c, "r"), (None, d, "s"), (None, f"{d} {item} {a}", "s"), (7, "", "s"), (8, None, "s"), (3, f"x {item} y", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    one = [tuple(r) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(one, key=str) == sorted([(2, a, "s"), (5, b, "s"), (9, c, "r"), (None, d, "s"), (None, f"{d} {item} {a}", "s"), (7, "", "s"), (8, None, "s"), (3, f"x {item} y", "s")], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [tuple(r) for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([x for x in rows if item not in (x[1] or "")], key=str)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_words():
    found, at = common.words_of(pa.array(["A b\x0bc", "", "  ", "é\x85x Y"]))
    assert found.to_pylist() == [b"a", b"b", b"c", "é\x85x".encode(), b"y"] and at.tolist() == [0, 3, 3, 3, 5]
