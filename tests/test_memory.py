"""Operators on memory, graphs and events that no registered query runs."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import columns as X
from lorekeep.operators import answering as A
from lorekeep.operators import consistency as Z
from lorekeep.operators import extraction as T
from lorekeep.operators import fusion as M
from lorekeep.operators import graph as G
from lorekeep.operators import memory as Y
from lorekeep.operators import provenance as P


def test_views_and_profiles(spark):
    v = spark.createDataFrame([("a", 1, 0, 40), ("b", 0, 0, 3), ("c", 0, 2, None)], "k string, overdue_commitments long, critical_risks long, days_since_contact long")
    got = {r["k"]: (r["needs_attention"], r["reasons"]) for r in Y.flagged(v).collect()}
    assert got == {"a": (True, ["1 overdue commitment(s)", "no contact for 40 days"]), "b": (False, []), "c": (True, ["2 critical risk(s)"])}
    e = spark.createDataFrame([("a",), ("b",)], "k string")
    parts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "k string, n int, v string")
    assert {r["k"]: [tuple(x) for x in r["items"]] for r in Y.profile(e, "k", items=parts).collect()} == {"a": [(1, "x"), (2, "y")], "b": []}
    counted = Y.added(e.withColumn("n", F.lit(3)), spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, item_id int"), "k", "n")
    assert {r["k"]: r["n"] for r in counted.collect()} == {"a": 5, "b": 3}


def test_arrays_of_structs(spark):
    rows = spark.createDataFrame([(1, [("x@a", "sender"), ("y@a", "cc")]), (2, [("z@a", "cc")]), (3, []), (4, None)], "i int, people array<struct<email:string,role:string>>")
    assert [r["i"] for r in Y.holding(rows, "people", email="y@a", role="cc").collect()] == [1]
    got = {r["i"]: r["p"] and r["p"]["email"] for r in rows.select("i", Y.by_role(F.col("people"), "sender").alias("p")).collect()}
    assert got == {1: "x@a", 2: "z@a", 3: None, 4: None}


def test_pending_and_embedded(spark):
    c = spark.createDataFrame([("k1", "abc"), ("k2", "de"), ("k3", "")], "chunk_id string, text string")
    vectors = Y.embedded(Y.pending(c, c.where("chunk_id = 'k1'"), 5))
    assert {r["chunk_id"]: len(r["vector"]) for r in vectors.collect()} == {"k2": 64, "k3": 64}


def test_typed_links(spark):
    rows = spark.createDataFrame([("p", "doc-1")], "source string, target string")
    r = G.linked(rows, "project", "document").first()
    assert (r["type"], r["target"]) == ("produced", str(uuid.UUID(hashlib.md5(b"doc-1").hexdigest())))
    with pytest.raises(ValueError):
        G.linked(rows, "project", "risk", "works_at")


def test_nicknames(spark):
    rows = spark.createDataFrame([("bob brown", "robert brown"), ("jane", "john"), ("", "x")], "a string, b string")
    got = [r["s"] for r in rows.select(X.nickname_likeness(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0


def test_event_rows(spark):
    m = spark.createDataFrame([(1, "t" * 600, "text", ["a", "b"], ["d"]), (2, "x", "text", None, None)], "id int, title string, text string, agenda array<string>, decisions array<string>")
    got = {r["id"]: (r["event_type"], r["importance"], r["description"], len(r["title"])) for r in T.event_rows(m, "meeting_notes").collect()}
    assert got == {1: ("meeting_held", 0.65, "Agenda: a; b | Decisions: d", 512), 2: ("meeting_held", 0.45, None, 1)}
    assert T.event_rows(m, "contract").first()["event_type"] == "contract_signed"
    assert T.event_rows(m, "email").first()["event_type"] == "email_sent"


def test_repairs_and_order(spark):
    e = spark.createDataFrame([(1, True), (2, True)], "edge_id int, is_active boolean")
    assert {r["edge_id"]: r["is_active"] for r in Z.without_broken(e, e.where("edge_id = 2")).collect()} == {1: True, 2: False}
    rows = spark.createDataFrame([("g", "x", 3), ("g", "x", 1), ("g", "y", 2)], "g string, k string, o int")
    assert {(r["k"], r["o"]) for r in M.in_order(rows, "g", "k", "o").collect()} == {("x", 1), ("y", 2)}
    ids = spark.createDataFrame([(["a", "b"],)], "c array<string>").select(M.fused_id(F.col("c")).alias("i")).first()["i"]
    assert ids.startswith("fusion_") and len(ids) == 19


def test_unrelated_chunks_are_not_fused(spark):
    schema = "question_id int, chunk_id string, text string, ts timestamp, company string, project string, person string, tags array<string>, relationships array<string>"
    rows = [(1, "a", "one two three", None, "Acme", "", "", [], []), (1, "b", "four five six", None, "Acme", "", "", [], []), (2, "c", "one two three", None, "Acme", "", "", [], []), (1, "d", "seven", None, "Acme", "", "", [], ["a"])]
    got = {tuple(r["chunk_ids"]) for r in M.fuse(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "d")}  # b shares no word, c belongs to another question, d is linked


def test_sections_that_do_not_fit_are_passed_over(spark):
    s = spark.createDataFrame([(1, 0, "Identity", "x" * 400), (1, 1, "Timeline", "y" * 4000), (1, 2, "Deadlines", "z" * 40)], "question_id int, section int, title string, content string")
    got = {r["title"]: (r["decision"], r["share"], r["final_tokens"]) for r in A.fit_context(s, F.lit(300), F.lit(180)).collect()}
    assert got == {"Identity": ("include_full", 190, 100), "Timeline": ("exclude", 100, 0), "Deadlines": ("include_full", 10, 10)}


def test_evidence(spark):
    r = spark.createDataFrame([("p", 1, "email", "d2", "2024-02-01", ["x"], "e" * 3000, 1.0), ("p", 1, "email", "d1", "2024-01-01", ["y"], "", 1.0)], "item_type string, item_id int, source_type string, document_id string, source_at string, people array<string>, excerpt string, confidence double")
    r = r.withColumn("source_at", F.col("source_at").cast("timestamp_ntz"))
    kept = P.recorded(r.limit(0), r)
    assert [x["document_id"] for x in P.evidence(kept, "p", 1).collect()] == ["d1", "d2"] and kept.agg(F.max(F.length("excerpt"))).first()[0] == 2000
    assert P.summary(kept).first()["summary"] == "Based on 2 emails (2024-01-01 to 2024-02-01)"
    one = kept.select(P.full_citation(F.col("source_type"), F.lit("Jan 01, 2024"), F.col("people"), F.col("document_id"), F.lit(""), F.lit("/x"), F.col("confidence")).alias("c")).where("c like '%d1%'").first()["c"]
    assert one == "Source     : EMAIL\nDate       : Jan 01, 2024\nParticipants: y\nReference  : d1\nLocation   : /x\nConfidence : 100%"
