"""Operators with their real banks on small fixtures."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from lorekeep.functions import columns as X
from lorekeep.operators import commitments as K
from lorekeep.operators import detectors as D
from lorekeep.operators import entities as E
from lorekeep.operators import extraction as T
from lorekeep.operators import graph as G
from lorekeep.operators import retrieval as V
from lorekeep.sources import files, normalise
from lorekeep.streaming import sync


def one(spark, col, **values):
    return spark.createDataFrame([Row(**values)]).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, X.company_key(F.col("n")), n="Acmé  Holdings Ltd.") == "acme"
    assert one(spark, X.urgency(F.lit(None).cast("int")), n=1) == 0.1
    assert [one(spark, X.urgency(F.lit(d)), n=1) for d in (-1, 0, 1, 3, 7, 14, 30, 31)] == [1.0, 0.95, 0.9, 0.8, 0.7, 0.55, 0.35, 0.15]
    assert one(spark, X.strip_html(F.col("n")), n="<p>a</p> <b>b</b>") == "a b"
    assert [one(spark, X.silence_penalty(F.lit(d)), n=1) for d in (6, 7, 90)] == [0.0, 0.05, 0.5]
    assert one(spark, X.tokens(F.col("n")), n="Éole le çeau naïve it's A_b x9") == ["le", "it", "s", "x9"]
    v = one(spark, X.stub_embedding(F.col("n")), n="abc")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_commitments_and_risks(spark):
    s = spark.createDataFrame([("I will send the report by Friday",), ("Nothing here at all",), ("waiting for regulator to reply on this",)], "sentence string")
    got = {r["sentence"]: (r["commitment_type"], r["confidence"], r["owner"]) for r in K.detect(s, F.lit("2024-05-15").cast("date")).collect()}
    assert got == {"I will send the report by Friday": ("deliverable", 0.9, "sender")}  # "will" holds the short form as well
    r = T.risks(spark.createDataFrame([(1, "The vendor delayed and approval pending, urgent")], "id long, text string"), "id", "text").collect()
    assert {(x["category"], x["severity"]) for x in r} == {("vendor", "high"), ("approval", "high")}


def test_events_and_questions(spark):
    e = T.events_of(spark.createDataFrame([("the contract signed today",), ("hello",)], "text string"), "text").collect()
    assert [(x["event_type"], x["is_milestone"]) for x in e] == [("contract_signed", True), ("email_sent", False)]
    q = T.classify_queries(spark.createDataFrame([("What risks exist around deployment?",), ("Who is John Smith?",)], "query string")).collect()
    assert [(x["intent"], x["entities"]) for x in q] == [("risk_scan", []), ("identification", ["John Smith"])]


def test_sections_and_turns(spark):
    d = spark.createDataFrame([(1, "start of the text, long enough to stay\n# Head\n" + "body " * 10)], "id long, text string")
    assert [(r["title"]) for r in T.headed_sections(d, "id", "text").orderBy("section").collect()] == ["Introduction", "Head"]
    m = spark.createDataFrame([(1, "first turn is long enough\nOn Monday, someone wrote:\nsecond turn is long enough")], "id long, text string")
    assert T.email_turns(m, "id", "text").count() == 2
    w = T.word_windows(spark.createDataFrame([(1, " ".join(map(str, range(801)))), (2, "")], "id long, text string"), "id")
    assert [(r["chunk_index"], r["n_words"]) for r in w.orderBy("chunk_index").collect()] == [(0, 800), (1, 101)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "source long, target long")
    assert {tuple(r) for r in G.components(e, "source", "target").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert {tuple(r) for r in G.reach(e, spark.createDataFrame([(1,)], "node long"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_names(spark):
    assert E.name_score("john smith", "smith john") == 1.0
    assert E.name_score("j. smith", "john smith") >= 0.85
    assert E.name_score("john smith", "mary jones") < 0.6
    m = spark.createDataFrame([(1, "J. Smith", None), (2, "Bob Brown", "bob@x.com"), (3, "Zed Zed", None)], "mention_id long, name string, email string")
    ents = spark.createDataFrame([(10, "John Smith", "js@x.com"), (11, "Robert Brown", "BOB@x.com")], "entity_id long, name string, email string")
    alias = spark.createDataFrame([], "alias string, entity_id long, confidence double")
    got = {r["mention_id"]: (r["entity_id"], r["stage"]) for r in E.resolve(m, ents, alias).collect()}
    assert got.get(2) == (11, "email") and 3 not in got


def test_conflicts_and_upsert(spark):
    t = spark.createDataFrame([(1, "it was approved"), (1, "it was rejected"), (2, "fine")], "g long, text string")
    assert [(r["g"], r["conflicts"]) for r in V.conflicts(t, "g", "text").collect()] == [(1, [0])]
    a = spark.createDataFrame([(1, "x", 1)], "k long, v string, at long")
    b = spark.createDataFrame([(1, "y", 2), (2, "z", 1)], "k long, v string, at long")
    once = D.upsert(a, b, ["k"], "at")
    assert {tuple(r) for r in D.upsert(once, b, ["k"], "at").collect()} == {tuple(r) for r in once.collect()} == {(1, "y", 2), (2, "z", 1)}


def test_files_and_notes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hi")
    (tmp_path / "b.zip").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r["path"][-5:]: (r["kind"], r["status"]) for r in files.parsed(files.files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("text", "success"), "b.zip": ("unknown", "failed"), ".docx": ("docx", "failed")}
    n = spark.createDataFrame([("v/2024-01-02.md", "---\na: 1\n---\nsee [[Other|x]] and ![[img]] #tag", None)], "path string, content string, modified timestamp")
    r = normalise.note(n).first()
    assert (r["content_type"], [tuple(x) for x in r["relations"]]) == ("daily_note", [("links_to", "Other"), ("embeds", "img")])
    assert normalise.note_marks(n).first()["tags"] == ["tag"]


def test_sync_is_idempotent(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    (landing / "1.json").write_text('{"ts": "1.5", "channel": "c", "user": "u", "text": "hi", "type": "message"}\n{broken\n')
    sync.connector("chat")(normalise.chat)
    schema = "ts string, channel string, user string, text string, type string, subtype string, thread_ts string"
    for turn in ("a", "a", "b"):  # again from the checkpoint, then a full run
        sync.run_sync(spark, "chat", str(landing), out, schema, str(tmp_path / turn)).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    assert spark.read.json(out + "-quarantine").count() == 2
