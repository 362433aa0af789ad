"""Conversation repair, toxicity and source divergence against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import divergence, repair, toxicity

TURNS = "conv_id long, turn long, role string, text string, gone boolean, edit int"


# ------------------------------------------------------------------ conversation repair
def _best(rows):
    """Least (cost, edits, turns) by trying all edits, memoised by place, last initial and whether any turn is there."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def go(i, last, adds):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if adds < 3:
            for r in ("user", "assistant"):
                if r[0] in after[last]:
                    c, e, t = go(i, r[0], adds + 1)
                    found.append((c + 3, "I" + e, ((r, ""), *t)))
        if i < len(rows):
            role, text, must, cut = rows[i]
            c, e, t = go(i + 1, last, 0)
            found.append((c + 4, "D" + e, t))
            if not must:
                if role[:1] and role[:1] in after[last]:
                    c, e, t = go(i + 1, role[0], 0)
                    found.append((c + 3 * cut, "K" + e, ((role, text), *t)))
                for r in ("user", "assistant"):
                    if r[0] in after[last]:
                        c, e, t = go(i + 1, r[0], 0)
                        found.append((c + 3 + 3 * cut, "R" + e, ((r, text), *t)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "~", ())

    return go(0, "", 0)


def brute_repair(table):
    out, by = {}, {}
    for conv, turn, role, text in table:
        by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        told = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        if h:
            by[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, n, told = set(), Counter(), []
        for _, role, text in rows:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            again = (role, text) in seen
            seen.add((role, text))
            cut = bool(re.search(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\Z", text))
            n["blank" if blank else "duplicate" if again else "truncated" if cut else ""] += 1
            told.append((role, text, blank or again, cut and not blank and not again))
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, edits, kept = _best(tuple(told)) if rows else (0, "", ())
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_turns(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.choice((1, 2, 3, 5, 8, 13))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "supervisor"])
            text = rng.choice(["Yes.", "No", " \n", "", None, "Why?", f"It is {rng.randrange(99)}.", "naïve é!", "a. b"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    return [*rows, *rows[:3]]


@pytest.mark.parametrize("held", [1, 200_000])
def test_repair_matches_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(repair, "HELD", held)
    monkeypatch.setattr(repair, "CELLS", 40 if held == 1 else 1 << 20)
    rows = random_turns(3)
    table = spark.createDataFrame([(*r, True, 1) for r in rows], TURNS)
    damaged = repair.damaged(table)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(repair.applied(damaged, repair.edits(damaged))).collect()}
    assert got == brute_repair(rows)


def test_repair_of_long_and_empty_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.digests(repair.applied(repair.damaged(empty), repair.edits(repair.damaged(empty)))).count() == 0
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3000)]
    table = spark.createDataFrame([(*r, False, 0) for r in rows], TURNS)
    kept = [(r["edit"], r["role"], r["text"]) for r in repair.repair(table).collect()]
    assert kept == [("K", r, t) for _, _, r, t in rows]
    whole = repair.repair(spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string"))
    assert [(r["edit"], r["role"], r["text"]) for r in whole.collect()] == [("I", "user", ""), ("K", "assistant", "Hi.")]


# ------------------------------------------------------------------ toxicity
def slow_kernel(a, b):
    def features(w):
        w = f"^{w}$"
        out = Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            skipped = k - i - 2
            if skipped <= toxicity.SKIPS:
                out[w[i] + w[j] + w[k]] += toxicity.DECAY**skipped
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q[u] for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_string_kernel():
    rng = random.Random(1)
    some = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    marks = some[:7]
    got = toxicity.Landmarks(marks, "abcde").matrix(some)
    want = [[slow_kernel(a, b) for b in marks] for a in some]
    assert np.allclose(got, want, atol=1e-5)
    coarse = np.linspace(-1, 1, len(marks))
    machine = toxicity.Machine("abcde", marks, coarse, 0.25, -9.0, coarse, 0.5)
    assert np.allclose(machine.values(some), 0.5 + np.array(want) ** toxicity.POWER @ coarse, atol=1e-4)
    machine.gate = 99.0
    assert np.allclose(machine.values(some), 0.5 + np.minimum(0, 0.25 + np.array(want) @ coarse - 99) / 10, atol=1e-4)


def test_windows_cover_whole_texts():
    assert toxicity.windows("") == set() and toxicity.windows(" \n\t") == set()
    assert {"dont", "shout"} <= toxicity.windows("Don't SHOUT!!")
    assert "xyz" in toxicity.windows("an x y  z here") and "abc" in toxicity.windows("a. b. c.")
    long = "".join(chr(97 + i * i % 26) for i in range(333))
    found = toxicity.windows(long)
    assert all(len(w) <= toxicity.WINDOW for w in found) and {long[i : i + 12] for i in range(322)} == {w[i : i + 12] for w in found for i in range(len(w) - 11)}


def labelled(n, seed):
    rng = random.Random(seed)
    bad = ["blorgan", "vextrid", "quzzle"]
    word = lambda: "".join(rng.choice(["the", "an", "tion", "er", "ing", "lo", "re", "di"]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        toks, toxic = [word() for _ in range(rng.randrange(5, 80))], int(i % 4 == 0)
        if toxic:
            toks.insert(rng.randrange(len(toks)), rng.choice(bad))
        out.append((i, " ".join(toks), toxic))
    return out


def test_toxicity_learns_and_tolerates(spark):
    rows = labelled(400, 1)
    machine = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    fresh = labelled(200, 2)
    docs = spark.createDataFrame([(i, t, None, 1.0) for i, t, _ in fresh] + [(900, None, "x", 2.0), (901, "", None, 3.0), (902, "x" * 20_000 + " blorgan", None, 0.0), (903, "a quzzyle thing", None, 0.0), (904, "you b-l-o-r-g-a-n", None, 0.0), (905, "q u z z l e", None, 0.0), (None, "fine", None, 0.0)], "doc_id long, text string, value string, score double")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, machine).collect()}
    assert len(got) == 207 and all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[i] >= toxicity.LEAST_SCORE) != t for i, _, t in fresh)
    assert wrong <= 4
    assert all(got[i] >= toxicity.LEAST_SCORE for i in (902, 903, 904, 905)) and got[900] == got[901] < 0.3 and got[None] < 0.3


def test_toxicity_without_classes(spark):
    assert toxicity.fit(["a b"], [1]) is None and toxicity.fit([], []) is None and toxicity.fit(["", ""], [0, 1]) is None
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert toxicity.scores(docs, None, 0.25).first()["score"] == 0.25
    assert toxicity.scores(docs.where("false"), None).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    row = got.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == F.col("predicted")).alias("right")).first()
    assert row["n"] > 80 and row["right"] >= 0.88 * row["n"]


# ------------------------------------------------------------------ divergence
def brute_audit(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", term.findall((text or "").translate(low))
        groups.add((lang, source))
        n.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), d in docs.items() if l == lang and d >= least_docs)
        sources = sorted(s for l, s in groups if l == lang)
        size = lambda count: {t: 1 + 10**9 * (count(t) + 2) // (sum(map(count, kept)) + 2 * len(kept)) for t in kept}
        p = {s: size(lambda t: n[lang, s, t]) for s in sources}  # noqa: B023
        q = size(lambda t: sum(n[lang, s, t] for s in sources))  # noqa: B023
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence_matches_brute_force(spark, monkeypatch, small):
    if small:  # many cells, flushes and pairs of blocks
        monkeypatch.setattr(divergence, "TERMS", 5)
        monkeypatch.setattr(divergence, "BLOCK", 2)
        monkeypatch.setattr(divergence, "HELD", 3)
    rng = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "gamma-delta", "日本", "ß", "zeta", "eta", "IOTA", "iota"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", "xx", "a"), ("only few words", "xx", "b"), rows[0], rows[0]]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, value int, rank int")
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(table, 3, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 3, 4)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
