"""The training-data operators against brute force, round trips and edge cases."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lorekeep.llm import chat, jaccard, katz, licences, line_dedup, packing, pieces, quality, queries, sharding, topk
from lorekeep.llm.common import LOWER, WordHashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, blob string, size int, slot string"


def edge_docs(spark, rows=True):
    long_text = " ".join(f"w{i}" for i in range(9000))
    some = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, long_text), (6, long_text), (7, long_text + " end"), (7, "repeated id"), (8, "naïve café — 日本 <|im_end|>"), (None, "no id at all here")]
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", 0, "x", 1, "y") for i, t in some] if rows else [], DOCS)


@pytest.mark.parametrize("rows", [True, False])
def test_edges_do_not_crash(spark, rows):
    d = edge_docs(spark, rows)
    n = 10 if rows else 0
    assert packing.packed_documents(d).where("piece = 0").count() == n
    assert sharding.shard(d).count() == n
    assert line_dedup.drop_boilerplate(d).count() == n
    assert quality.judged(d).count() == n
    assert jaccard.near_duplicates(d).count() == n
    assert katz.katz_scores(d).count() == n
    assert licences.scan_licences(d).count() == n
    assert pieces.decode(pieces.encode(d, chunk=1000)).select("doc_id").distinct().count() == (9 if rows else 0)


def test_packing_plan_and_ids(spark):
    random.seed(1)
    for capacity in (7, 10, 50):
        for _ in range(60):
            counts = Counter(random.randint(1, capacity) for _ in range(random.choice((4, 30, 300))))
            bins = packing.plan(dict(counts), capacity)
            used = Counter()
            for lengths, n in bins:
                assert sum(s * q for s, q in lengths.items()) <= capacity
                for s, q in lengths.items():
                    used[s] += q * n
            assert used == counts
    best = lambda items, cap: min(best_of(items, cap))
    for _ in range(40):
        items = [random.randint(1, 10) for _ in range(8)]
        assert sum(n for _, n in packing.plan(dict(Counter(items)), 10)) <= best(items, 10) + 1
    d = edge_docs(spark)
    rows = packing.packed_documents(d).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    e = packing._Encoder(packing.tokenizer_path())
    for t in ["It's é. Été ÉTÉ! a.b c,, <|endoftext|> İstanbul 日本。 x́. 3.14, don't.", "Plain words, and marks."]:
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def best_of(items, cap):
    """Fewest bins by trying all orders of first fit on a few items."""
    import itertools

    for order in itertools.islice(itertools.permutations(sorted(items, reverse=True)), 2000):
        bins = []
        for x in order:
            for i, b in enumerate(bins):
                if b + x <= cap:
                    bins[i] += x
                    break
            else:
                bins.append(x)
        yield len(bins)


def test_minimax_is_smallest():
    random.seed(2)
    for _ in range(100):
        sizes = [random.randint(1, 30) for _ in range(random.randint(1, 12))]
        shards = random.randint(1, 5)
        got, cuts = sharding.minimax_cuts(sizes, shards)
        table = {}

        def best(i, k):
            if i == len(sizes):
                return 0
            if k == 0:
                return math.inf
            if (i, k) not in table:
                table[i, k] = min(max(sum(sizes[i:j]), best(j, k - 1)) for j in range(i + 1, len(sizes) + 1))
            return table[i, k]

        assert got == best(0, shards) and cuts[-1] == len(sizes) and len(cuts) <= shards


def test_shards(spark):
    rows = sharding.op5_minimax_sharding(spark, SF).collect()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {r[0]: zlib.crc32(r[1].encode()) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == sorted(got.columns)
    mine = sorted(tuple(r) for r in got.select(*rel.columns).collect())
    assert mine == sorted(map(tuple, rel.fetchall()))


def brute_components(rows, percent=75):
    def sh(t):
        w = (t or "").encode().translate(LOWER).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: sh(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("small,chunk,heads", [(8, 64, 4), (2, 3, 1)])
def test_join_finds_every_link(spark, monkeypatch, small, chunk, heads):
    for name, value in {"BLOCK_SIGS": 3000, "SMALL": small, "CHUNK": chunk, "CELL": chunk, "LIST": chunk, "HEADS": heads}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(5)
    rows = []
    for g in range(30):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.choice((3, 8, 20, 60, 200)))]
        for _ in range(rng.choice((1, 2, 14))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows) + 1, " ".join(w)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows)


def test_signatures_meet():
    rng, none = random.Random(7), WordHashes()
    for _ in range(300):
        a = [f"t{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 120))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 8))):
            b[rng.randrange(len(b))] = f"u{rng.randint(0, 10**9)}"
        x, y = (np.unique(np.frombuffer(b"".join(none[w.encode()] for w in s), "<u8")) for s in (a, b))
        if jaccard.linked(x, y):
            zero = [np.zeros(len(s), bool) for s in (x, y)]
            assert set(jaccard.signatures(x, zero[0]).tolist()) & set(jaccard.signatures(y, zero[1]).tolist())


def test_katz_is_normalised_and_matches(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 500)
    rng = random.Random(3)
    rows = [(i, " ".join(f"k{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 60)))) for i in range(200)]
    got = {r["doc_id"]: r for r in katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    toks = {i: [*t.split(), "</s>"] for i, t in rows}
    train = [w for i, w in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    uni, bi = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["<s>", *w], w))
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
    model = katz.Unigrams(sum(uni.values()), len(uni), of(uni))
    p = lambda w: float(model.p(np.array([uni.get(w, 0)]))[0])
    assert abs(sum(map(p, uni)) + p("<unknown>") - 1) < 1e-9
    d = [*katz.good_turing(of(bi)), 1.0]
    ctx = Counter(uni)
    ctx["<s>"] = len(train)
    after = {}
    for (a, b), c in bi.items():
        after.setdefault(a, {})[b] = c

    share = katz.share_of(model.n, 64)

    def prob(a, b):
        if a not in after:
            return p(b)
        seen = after[a]
        h = katz.HALF if ctx[a] > share or min(seen.values()) > katz.K else 0.0
        if b in seen:
            return d[min(seen[b], katz.K + 1) - 1] * seen[b] / (ctx[a] + h)
        left = (sum(c * (1 - d[min(c, katz.K + 1) - 1]) for c in seen.values()) + h) / (ctx[a] + h)
        return left / (1 - sum(map(p, seen))) * p(b)

    for a in list(after)[:20]:
        assert abs(sum(prob(a, w) for w in uni) + prob(a, "<unknown>") - 1) < 1e-6
    for i, w in toks.items():
        assert abs(got[i]["score"] - sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *w], w))) < 1e-6


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("<\\|ab>im_end") for _ in range(30))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "%\n")) == t + "%\n"


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "<|im_end|>"), (1, None, "assistant", ""), (None, 0, "assistant", "x"), (1, 1, None, "<|im_end|>")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_turns(t)).collect()}
    assert got == {1: (4, 0), None: (1, 1)}


def test_licences_full_text():
    rec = licences.Recogniser()
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    assert [f[0] for f in rec.scan("Copyright (c) 2020 X\n" + mit)[1]] == ["MIT"]
    for text, want in {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause"}.items():
        assert [f[0] for f in rec.scan(f"Some prose here. {text}\nMore prose.")[1]] == [want], text
    assert rec.scan("No such thing as a permission here.")[1] == []


def test_pieces_against_library_and_chunks():
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pieces.Model(pieces.model_path())
    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.model_path(), "rb").read())
    proto.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 40").fetchall()] + ["thequickbrownfox" * 30, "日本語 naïve"]
    for t in texts:
        s = pieces.normalise(t[:1500])
        whole = m.trace(s, len(s), 0, 0)
        assert m.decode(np.frombuffer(whole[1], "<u4").tolist()) == " " + t[:1500]
        line = t[:300].split("\n")[0]
        if line and line.isascii() and "  " not in line and not line.endswith(" "):
            mine = m.trace(pieces.normalise(line), len(line) + 1, 0, 0)[0]
            assert mine == pytest.approx(sum(m.score.get(p, m.unknown) for p in lib.nbest_encode_as_pieces(line, 2)[0]))
        for c in (20, 333):
            edges = pieces.split_points(s, c, m.longest)
            parts = [(s[a : b + m.longest - 1], b - a) for a, b in zip(edges, edges[1:])]
            path = pieces.states([m.matrix(x, n) for x, n in parts])
            got = [m.trace(x, n, a, b) for (x, n), (a, b) in zip(parts, path)]
            assert sum(g[0] for g in got) == pytest.approx(whole[0])
            assert m.decode(np.frombuffer(b"".join(g[1] for g in got), "<u4").tolist()) == " " + t[:1500]


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [1.0, -2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (100, [0.0, 0.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.threshold_topk(v, v.where("vec_id % 50 = 0"), k=3, block_rows=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 100), (50, 100), (50, 0), (50, 1), (100, 0), (100, 1), (100, 2)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = docs.collect()
    hashes = WordHashes()
    kept = [r for r in rows if not any(rule.rejects(quality.Measured(r["text"], hashes)) for rule in quality.RULES)]
    per_host, seen = Counter(r["source"] for r in kept), Counter()
    for r in kept:
        seen.update((r["source"], x) for x in {x for x in r["text"].split("\n") if x.encode().split()})
    bad = {k for k, n in seen.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * per_host[k[0]]}
    cleaned = [(r["doc_id"], "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)) for r in kept]
    comp = brute_components(cleaned)
    want = {i for i in comp if comp[i][1] == i}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == want


def test_solved_equals_own_forward():
    m = pieces.Model(pieces.model_path())
    texts = ["", "<0x41>", "a<s>b", "x</s> <unk> y<0xE3>", "日本<s>語 テキスト", "😀😀é", "   x ", "a\n\tb" * 50, "x" * 300, "plain words, some rarer: zyxwv qqq"]
    for s in map(pieces.normalise, texts):
        assert m.solved(s) == m.plain(s)


def test_planes_round_trip():
    import numpy as np
    import zstandard

    arrays = [np.array([0, 1, 2**63], np.uint64), np.zeros(0, np.uint32), np.array([-1.5, 2.0]), np.array([7], np.uint8), np.zeros(0, np.float64)]
    blob = katz._pack(zstandard.ZstdCompressor(), *arrays)
    back = katz._open(zstandard.ZstdDecompressor(), blob, *(a.dtype for a in arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back))
