"""Edges of chat formatting, top-k, the pipeline and chunked encoding; packing against brute force; licence headers."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import chat, licences, packing, pieces, quality, topk

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, ids string, mask int"


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", None, "y", 2), (1, 1, "assistant", None, "y", 2), (None, None, None, "", "z", 3)]])
def test_chat_empty_and_clashing_columns(spark, rows):
    t = spark.createDataFrame(rows, TURNS).select("conv_id", "turn", "role", "text", "ids", "mask")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_turns(t.select("conv_id", "turn", "role", "text"))).collect()}
    assert got == ({1: 3, None: 1} if rows else {})


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 7, 8, "a"), (1, [0.5, 2.0], 7, 8, "b"), (1, [0.5, 2.0], 9, 9, "c"), (2, None, 1, 1, "d")]])
def test_topk_empty_and_clashing_columns(spark, rows):
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int, block string")
    v = topk.quantised(e)
    got = [tuple(r) for r in topk.threshold_topk(v, v.where("vec_id % 50 = 0")).collect()]
    assert got == ([(0, 1, 1, 256 * 128 + 512 * 512)] if rows else [])


def test_rules_without_measures_agree(spark):
    d = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text")
    full = {r[0]: r[1] for r in quality.judged(d).select("doc_id", "kept").collect()}
    assert {r[0]: r[1] for r in quality.judged(d, measures=False).select("doc_id", "kept").collect()} == full
    few = quality.judged(d, rules=(quality.RULES[2],), measures=False).where("kept").count()
    assert few <= quality.judged(d).where("not base_failed").count()


@pytest.mark.parametrize("rows", [True, False])
def test_pipeline_edges(spark, tmp_path, rows):
    import corpus_pipeline

    prose = " ".join(f"word{i} of{i % 7}" for i in range(200))
    some = [(1, prose, "en", "s", 3), (2, prose, None, "s", 3), (2, prose + " more", "en", None, None), (3, None, None, None, None), (4, "", "", "", 0), (None, "no id " + prose[::-1], "en", "s", 1), (5, prose.upper() * 9, "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int"
    spark.createDataFrame([(*r, "x", 1) for r in some] if rows else [], schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    got = {r["doc_id"] for r in out.collect()}
    assert (1 in got and 3 not in got and 4 not in got) if rows else not got


def test_packing_never_beyond_plain_best_fit_and_known_optimum():
    assert sum(n for _, n in packing.plan({5: 1, 2: 2}, 15)) == 1
    rng = random.Random(4)
    for _ in range(1500):
        capacity = rng.choice((10, 15, 30, 100))
        counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.choice((3, 8, 20, 60)))))
        plain = sum(n for _, n in packing.best_fit(counts, capacity))
        assert sum(n for _, n in packing.plan(counts, capacity)) <= plain, (counts, capacity)


def test_packed_query_against_brute_force(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want, lengths = {}, []
    for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            lengths.append(len(part))
            want[r["doc_id"], k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = packing.op1_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048
    assert -(-sum(lengths) // 2048) <= len(ends) <= sum(n for _, n in packing.best_fit(dict(Counter(lengths)), 2048))


def test_chunked_ids_are_those_of_the_whole_text(spark):
    texts = [r["text"] for r in spark.read.parquet(SF + "/documents.parquet").orderBy("doc_id").limit(12).collect() if r["text"]]
    d = spark.createDataFrame([(i, t and t[:4000]) for i, t in enumerate([*texts, "x" * 900, "", None, "naïve 日本 text " * 40])], "doc_id long, text string")

    def joined(chunk):
        out = {}
        for r in pieces.encode(d, chunk=chunk).orderBy("doc_id", "chunk").collect():
            ids, score = out.get(r["doc_id"], (b"", 0.0))
            out[r["doc_id"]] = (ids + bytes(r["ids"]), score + r["score"])
        return out

    whole, cut = joined(10**9), joined(300)
    assert whole.keys() == cut.keys()
    for k, (ids, score) in whole.items():
        assert cut[k][1] == pytest.approx(score)
        if k != len(texts):  # a text without a blank may take another path of the same score
            assert cut[k][0] == ids


HEADERS = {
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
}


@pytest.mark.parametrize("width", [40, 72, 100, 10_000])
def test_headers_at_any_width(width):
    import textwrap

    for want, text in HEADERS.items():
        found = [f[0] for f in licences.Recogniser().scan("\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)))[1]]
        assert found == [want], (want, width, found)


def test_sentences_far_apart_are_no_licence():
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."]
    far = "Plain prose that says nothing of the kind. " * 40
    names = lambda text: [f[0] for f in licences.Recogniser().scan(text)[1]]
    assert names("\n".join(mit)) == ["MIT"]
    assert names(f"{mit[0]}\n{far}\n{mit[1]}\n{mit[2]}") == ["MIT-partial"]
    assert names(mit[0] + "\n" + "Copyright (c) 2020 Somebody\n" * 60 + mit[1] + "\n" + mit[2]) == ["MIT"]
    assert names("x" * 300_000 + "\n" + "\n".join(mit * 3)) == ["MIT"] * 3
