"""The full-text index: batches, removals, compaction, pruning, failure."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import index as I

WORDS = {"ponies": "pony", "ties": "ty", "aies": "aies", "churches": "churche", "shoes": "shoes", "aes": "aes", "cats": "cat", "bus": "bus", "class": "class", "s": "s", "is": "i", "cat": "cat"}


def test_stem(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", I.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == WORDS


def plain(texts, query, k=10):
    n = {d: len(t) for d, t in texts.items()}
    avg, df = sum(n.values()) / len(n), Counter(w for t in texts.values() for w in set(t))
    score = {}
    for d, t in texts.items():
        tf = Counter(t)
        got = [math.log((len(n) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * n[d] / avg)) for w in query if tf[w]]
        if got:
            score[d] = sum(got)
    top = max(score.values(), default=1)
    return {d: round(s / top, 9) for d, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]}


def test_batches_replace_and_remove(spark, tmp_path):
    index = I.TextIndex(spark, str(tmp_path / "i"))
    assert index.bm25(["cat"], 5).count() == 0 and index.all_of(["cat"]).count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.update(frame([(1, "cats and dogs"), (2, "The dog. A cat, a cat!"), (3, None), (4, ""), (None, "cat"), (5, "zebra cat")]))
    with pytest.raises(ValueError):
        index.update(frame([(8, "bird"), (8, "zebra cat")]))
    texts = {1: ["cat", "dog"], 2: ["dog", "cat", "cat"], 3: [], 4: [], 5: ["zebra", "cat"]}
    ask = lambda: {r["doc_id"]: round(r["score"], 9) for r in index.bm25(["Cats", "dogs dog"], 10).collect()}
    assert ask() == plain(texts, ["cat", "dog"])
    index.update(frame([(1, "birds only"), (6, "dog")]), spark.createDataFrame([(5,), (77,), (None,)], "doc_id long"))
    texts |= {1: ["bird", "only"], 6: ["dog"]}
    del texts[5]
    assert ask() == plain(texts, ["cat", "dog"])
    assert [r[0] for r in index.all_of(["dog cat"]).collect()] == [2]
    assert index.all_of(["the of"]).count() == 0
    index.update(frame([(5, "a cat again")]))
    texts[5] = ["cat", "again"]
    assert ask() == plain(texts, ["cat", "dog"])
    before = ask()
    assert index.compact() == 1 and index.last() == 1 and ask() == before
    index.update(deleted=spark.createDataFrame([(2,)], "doc_id long"))
    del texts[2]
    assert ask() == plain(texts, ["cat", "dog"])


def test_a_failed_batch_leaves_no_trace(spark, tmp_path, monkeypatch):
    index = I.TextIndex(spark, str(tmp_path / "i"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.update(frame([(1, "cat"), (2, "dog")]))
    write = index._write

    def broken(name, *a):
        if name == "sizes":
            raise OSError("lost")
        write(name, *a)

    monkeypatch.setattr(index, "_write", broken)
    with pytest.raises(OSError):
        index.update(frame([(1, "bird"), (3, "cat")]))
    monkeypatch.setattr(index, "_write", write)
    assert [r[0] for r in index.all_of(["cat"]).collect()] == [1]
    index.update(frame([(4, "cat")]))
    assert sorted(r[0] for r in index.all_of(["cat"]).collect()) == [1, 4]


def test_a_query_reads_its_terms_folders(spark, tmp_path):
    index = I.TextIndex(spark, str(tmp_path / "i"))
    index.update(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit("x common")).alias("text")))
    found = index.postings(["word7x"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,word7x)" in plan.replace("In(term, [word7x])", "EqualTo(term,word7x)")
    assert [r["doc_id"] for r in found.collect()] == [7]


ODD = ["Kelvin cats 10K", "İs İcats ẋcats", "a_b cat's cafés cáts x² ²x y①", "the ties\nties\tIS s es ies aies glass bus", "_ __ cats_ _cats", "дcat catд cat-д ٣cats", "", None, "naïve O'Hare's 3rd 007s ﬁsh sſ ẞ"]


def test_postings_are_the_terms_of_the_text(spark, tmp_path, monkeypatch):
    """Stored terms, counts and sizes are those of terms(), whatever stands beside the ASCII words, and however many are put together."""
    monkeypatch.setattr(I, "TOGETHER", 50)
    docs = spark.createDataFrame([(i, ODD[i % len(ODD)]) for i in range(600)], "doc_id long, text string").repartition(1)
    told = {r["doc_id"]: r["t"] for r in docs.select("doc_id", I.terms(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    want = {(t, d, n, len(ts)) for d, ts in told.items() for t, n in [(None, 0), *Counter(ts).items()]}
    index = I.TextIndex(spark, str(tmp_path / "i"))
    index.update(docs)
    for _ in range(2):
        at = index.generation()
        got = [tuple(r)[:4] for r in index._each(index._read("postings", at)).collect()]
        assert len(got) == len(want) and {*got} == want
        index.compact()
    assert index._read("docs", 2).count() == 600


def test_a_common_term_makes_few_rows(spark, tmp_path):
    """Rows that are shuffled and sorted grow with the terms of some thousand documents, not with each document that holds a term."""
    index = I.TextIndex(spark, str(tmp_path / "i"))
    index.update(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("common words").alias("text")).coalesce(2))
    for generation in (0, 1):
        assert index._read("postings", generation).count() <= 3 * 8
        assert index.all_of(["common word"]).count() == 3000 and index._read("docs", generation).count() == 3000
        index.compact()


def test_texts_cut_in_parts_have_the_terms_of_the_text(spark, tmp_path, monkeypatch):
    """However few bytes are cut at once, and where bytes are no UTF-8."""
    monkeypatch.setattr(I, "AT_ONCE", 60)
    monkeypatch.setattr(I, "TOGETHER", 50)
    odd = ODD + ["cats—dogs…birds s x", "end cats", " cats", "cats\x00dogs\x1fÅb", "É" * 40 + " cat"]
    rows = [(i, odd[i % len(odd)]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.sql("SELECT 80L, CAST(x'63617473ff20646f6773' AS string)")).repartition(2)
    told = {r["doc_id"]: r["t"] for r in docs.select("doc_id", I.terms(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    want = {(t, d, n, len(ts)) for d, ts in told.items() for t, n in [(None, 0), *Counter(ts).items()]}
    index = I.TextIndex(spark, str(tmp_path / "i"))
    index.update(docs)
    got = [tuple(r)[:4] for r in index._each(index._read("postings", 0)).collect()]
    assert len(got) == len(want) and {*got} == want


def test_work_in_python_is_done_once_for_a_term(monkeypatch):
    """Lines of Python that run grow with the different terms of some megabytes of text, not with the postings."""
    import sys

    import pyarrow as pa

    def lines(docs):
        ran = [0]

        def trace(frame, event, arg):
            ran[0] += event == "line"
            return trace

        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(docs), pa.int64()), "text": [" ".join(f"word{i}" for i in range(100))] * docs})
        before = sys.gettrace()
        sys.settrace(trace)
        try:
            out = list(I._counted([])([batch]))
        finally:
            sys.settrace(before)
        assert sum(len(x["doc_ids"].flatten()) for x in out) == 101 * docs
        return ran[0]

    assert lines(1000) < 2 * lines(10)
