"""Normalisers of pages, notes and files, stores, streams and detectors that no registered query runs."""

import datetime
import json

from pyspark.sql import functions as F

from lorekeep.functions import columns as X
from lorekeep.operators import detectors as D
from lorekeep.operators import entities as E
from lorekeep.operators import extraction as T
from lorekeep.operators import retrieval as V
from lorekeep.sources import normalise as N
from lorekeep.streaming import sync

PROPS = {
    "Name": {"type": "title", "title": [{"plain_text": "My "}, {"plain_text": "page"}]}, "Note": {"type": "rich_text", "rich_text": [{"plain_text": "x"}]}, "Kind": {"type": "select", "select": {"name": "A"}}, "State": {"type": "status", "status": None},
    "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, "Due": {"type": "date", "date": {"start": "2024-05-01"}}, "Done": {"type": "checkbox", "checkbox": True}, "N": {"type": "number", "number": 3.0}, "F": {"type": "number", "number": 2.5},
    "Url": {"type": "url", "url": "http://x"}, "Who": {"type": "people", "people": [{"id": "u1"}, {"id": "u2"}]}, "Rel": {"type": "relation", "relation": [{"id": "p9"}]}, "Sum": {"type": "formula", "formula": {"type": "number", "number": 7}}, "Odd": {"type": "rollup", "rollup": {}},
}


def test_properties_and_pages(spark):
    rows = [("p1", "t", "body", "up", None, "2024-01-01T00:00:00Z", json.dumps(PROPS), [("ann", "hello"), (None, "there"), ("bob", "")]), ("p2", None, None, None, "db", None, None, [])]
    raw = spark.createDataFrame(rows, "id string, title string, content string, parent_id string, database_id string, last_edited string, properties string, comments array<struct<author:string,text:string>>")
    got = raw.select(N.properties(F.col("properties")).alias("p"), N.page_title(F.col("properties")).alias("t")).collect()
    assert got[0]["p"] == {"Name": "My page", "Note": "x", "Kind": "A", "State": None, "Tags": "a, b", "Due": "2024-05-01", "Done": "true", "N": "3", "F": "2.5", "Url": "http://x", "Who": "u1, u2", "Rel": "p9", "Sum": "7", "Odd": None}
    assert [r["t"] for r in got] == ["My page", "Untitled"]
    a, b = N.page(raw).orderBy("doc_id").collect()
    assert [tuple(x) for x in a["relations"]] == [("child_of", "up"), ("relates_to:Rel", "p9")] and a["body"] == "body\n\n--- Comments ---\n[Comment by ann]: hello\n[Comment by unknown]: there"
    assert [tuple(x) for x in b["relations"]] == [("record_in", "db")] and b["body"] is None
    since = N.edited_since(raw, F.lit("2024-06-01").cast("timestamp"))
    assert [r["id"] for r in since.collect()] == ["p2"]


def test_databases(spark):
    raw = spark.createDataFrame([("d1", "Tasks", {"Name": "title", "Due": "date"}, None), ("d2", "Empty", {}, None)], "id string, title string, schema map<string,string>, last_edited string")
    records = spark.createDataFrame([(f"r{i:03}", "d1") for i in range(120)], "id string, database_id string")
    a, b = N.database(raw, records).orderBy("doc_id").collect()
    assert a["body"] == "Database: Tasks\n\nSchema:\n  Due: date\n  Name: title\n\nRecords: 120" and len(a["relations"]) == 100 and a["relations"][0]["target"] == "r000"
    assert b["body"].endswith("Records: 0") and b["relations"] == []


def test_blocks(spark):
    kinds = [("paragraph", "p"), ("heading_2", "h"), ("to_do", "t"), ("bulleted_list_item", "b"), ("toggle", "g"), ("divider", None), ("image", "cap"), ("unknown", "u"), ("paragraph", "")]
    rows = [(f"b{i}", None, "pg", i, k, t, k == "to_do") for i, (k, t) in enumerate(kinds)] + [("c0", "b4", "pg", 0, "quote", "inside", None), ("c1", "c0", "pg", 0, "code", "x=1", None)]
    blocks = spark.createDataFrame(rows, "block_id string, parent_id string, page_id string, pos int, type string, text string, checked boolean")
    text = N.blocks_to_text(N.nested(blocks)).first()["content"]
    assert text == "p\n## h\n- [x] t\n- b\n▶ g\n  inside\n    ```\nx=1\n```\n---\n[IMAGE: cap]"


def test_notes_and_canvases(spark):
    body = "---\ntitle: My note\ntags:\n  - one\n  - two\n---\nsee [[Other#Part|x]], ![[img.png]] and [due:: 2024] [due:: 2025]"
    files = spark.createDataFrame([("v/n.md", body, None), ("v/c.canvas", '{"nodes": [{"type": "text", "text": "hi"}, {"type": "file", "file": "n.md"}, {"type": "group"}]}', None), ("v/bad.canvas", "{", None)], "path string, content string, modified timestamp")
    n = N.note(files.where("path like '%.md'")).first()
    assert [tuple(x) for x in n["relations"]] == [("links_to", "Other"), ("embeds", "img.png")]
    marks = files.select(N.front_matter(F.col("content")).alias("f"), N.dataview_fields(F.col("content")).alias("d")).first()
    assert marks["f"] == {"title": "My note", "tags": "one,two"} and marks["d"] == {"due": "2025"}
    got = {r["title"]: (r["body"], [tuple(x) for x in r["relations"]]) for r in N.canvas(files.where("path like '%.canvas'")).collect()}
    assert got["c"] == ("[Canvas]\nhi\n[Linked: n.md]", [("canvas_references", "n.md")]) and got["bad"][1] == []
    assert N.local_file(files).where("title = 'n.md'").first()["source"] == "local"


def test_stores(spark):
    c = spark.createDataFrame([("k1", "d1", None, 3), ("k2", "d2", "x", 4)], "chunk_id string, doc_id string, title string, n int")
    assert [r["payload"] for r in N.payload(c, "title", "n").orderBy("chunk_id").collect()] == ['{"n":3}', '{"title":"x","n":4}']
    assert N.without_documents(c, c.where("n = 3")).count() == 1
    f = spark.createDataFrame([("1", "a", None), ("2", "b", "1"), ("3", "c", "2")], "id string, name string, parent string")
    assert {r["id"]: r["path"] for r in N.folder_paths(f).collect()} == {"1": "a", "2": "a/b", "3": "a/b/c"}


def test_files_of_a_vault(spark):
    import hashlib

    from lorekeep.sources import files

    f = spark.createDataFrame([("/v/a.md", "text/plain"), ("/v/.git/b.md", None), ("/v/x/c.canvas", None), ("/v/d.PNG", None), ("/v/e.xyz", "application/pdf"), ("/v/f.xyz", None)], "path string, mime string")
    assert {r["path"]: r["vault_kind"] for r in files.vault(f, "/v").collect()} == {"/v/a.md": "note", "/v/x/c.canvas": "canvas", "/v/d.PNG": "attachment"}
    assert [r["k"] for r in f.select(files.kind_of(F.col("path"), F.col("mime")).alias("k")).collect()] == ["text", "text", "unknown", "image", "pdf", "unknown"]
    got = N.attachment_file(f.withColumn("modified", F.lit(None).cast("timestamp"))).where("title = 'd.PNG'").first()
    assert (got["content_type"], got["body"]) == ("attachment", "")
    d = spark.createDataFrame([("email", "7", 'say "hi"\n', "x" * 2000, None)], "s string, i string, t string, c string, a string")
    h = d.select(X.document_hash(*[F.col(c) for c in ("s", "i", "t", "c", "a")]).alias("h")).first()["h"]
    text = json.dumps({"source_type": "email", "source_id": "7", "title": 'say "hi"\n', "content": "x" * 1000, "created_at": None}, sort_keys=True)
    assert h == hashlib.sha256(text.encode()).hexdigest()


def test_modes_and_logs(spark, tmp_path):
    import pytest

    assert sync.checkpoint_of("/c", "resume") == sync.checkpoint_of("/c", "incremental") != sync.checkpoint_of("/c", "full") != sync.checkpoint_of("/c", "full")
    with pytest.raises(ValueError):
        sync.checkpoint_of("/c", "often")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"ts": "1.5", "channel": "c", "user": "u", "text": "hi", "type": "message"}\n')
    sync.connector("chat")(N.chat)
    schema = "ts string, channel string, user string, text string, type string, subtype string, thread_ts string"
    run = sync.run_sync(spark, "chat", str(tmp_path / "in"), str(tmp_path / "out"), schema, sync.checkpoint_of(str(tmp_path / "ck"), "full"))
    run.awaitTermination()
    assert sync.sync_log(spark, run).agg(F.sum("found")).first()[0] == 1
    raw = spark.createDataFrame([("2024-05-01 00:00:00",), ("2024-01-01 00:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert N.looked_back(raw, F.col("t"), F.lit("2024-05-15").cast("timestamp")).count() == 1


def test_streams(spark, tmp_path):
    at = lambda m: f"2024-05-01T10:{m:02}:00"
    (tmp_path / "in").mkdir()
    turns = [[("c1", "open", 0), ("c2", "open", 1), ("c1", "open", 2)], [("c1", "resolved", 5), ("c1", "late", 3), ("c2", "in_progress", 4)]]
    schema = "commitment_id string, status string, changed_at timestamp"
    for i, rows in enumerate(turns):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"commitment_id": k, "status": s, "changed_at": at(m)}) for k, s, m in rows))
        stream = sync.running_status(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    got = {(r[0], r[1], r[2]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("c1", None, "open"), ("c2", None, "open"), ("c1", "open", "late"), ("c1", "late", "resolved"), ("c2", "open", "in_progress")}
    events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for name, q, mode in (("once", sync.deduplicated(events, "commitment_id", "changed_at"), "append"), ("wide", sync.windowed_counts(events, "changed_at", "commitment_id", "1 hour"), "complete")):
        q.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2 and sum(r["n"] for r in spark.table("wide").collect()) == 6
    assert sync.success_rate(0, 0) == 1.0 and sync.success_rate(4, 3) == 0.75


def test_detectors(spark):
    m = spark.createDataFrame([("a", "a delay"), ("a", "this issue"), ("a", "we are blocked"), ("a", "fine"), ("b", "urgent")], "company string, text string")
    assert [tuple(r) for r in D.negative_pattern(m, "company", "text").collect()] == [("a", 3, "medium")]
    p = spark.createDataFrame([("x", datetime.date(2024, 5, 1)), ("y", datetime.date(2024, 5, 10)), ("z", datetime.date(2024, 4, 1))], "project string, due date")
    assert {(r["project"], r["severity"]) for r in D.drift(p, "due", F.lit("2024-05-15").cast("date")).collect()} == {("x", "high"), ("z", "critical")}


def test_names_of_any_script(spark):
    rows = [(1, "Иван Петров"), (2, "李雷"), (3, "Łukasz Żak"), (4, "José  Núñez-O'Neil"), (5, "éa"), (6, "?!"), (7, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, n string").select("i", X.normalise_name(F.col("n"))).collect()}
    assert got == {1: "иван петров", 2: "李雷", 3: "lukasz zak", 4: "jose nunez-o neil", 5: "ea", 6: "", 7: None}
    m = spark.createDataFrame([(1, "?!", None), (2, "Иван Петров", ""), (3, "李雷", None)], "mention_id long, name string, email string")
    ents = spark.createDataFrame([(10, "...", ""), (11, "Иван Петров", None)], "entity_id long, name string, email string")
    alias = spark.createDataFrame([("!!", 10, 0.9), ("李雷", 12, 0.8)], "alias string, entity_id long, confidence double")
    assert {r["mention_id"]: (r["entity_id"], r["stage"]) for r in E.resolve(m, ents, alias).collect()} == {2: (11, "fuzzy"), 3: (12, "alias")}
    a = "kitten sitting on the mat"
    for b in ("sitting kitten", "", a, "xyz", "kitten"):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
        assert abs(E.indel_ratio(a, b) - 2 * row[-1] / (len(a) + len(b))) < 1e-12
    assert E.partial_ratio("acme", "the acme group") == 1.0 and E.partial_ratio("", "") == 1.0


def test_query_terms_are_tokens(spark):
    d = spark.createDataFrame([(1, "i like c and cc code"), (2, "nothing here"), (3, "Code review")], "id long, text string")
    assert {r["id"] for r in V.bm25(d, ["Code"], 9, "id", "text").collect()} == {1, 3}
    assert {r["id"] for r in V.bm25(d, ["c++"], 9, "id", "text").collect()} == {1}
    assert V.bm25(d, [".*", "?"], 9, "id", "text").count() == 0
    twice = V.bm25(d, ["code", "CODE code"], 9, "id", "text").collect()
    assert twice == V.bm25(d, ["code"], 9, "id", "text").collect()


def test_budget_goes_on_past_what_does_not_fit(spark):
    c = spark.createDataFrame([("g", 1, "x" * 40), ("g", 2, "x" * 400), ("g", 3, "x" * 40), ("g", 4, "x" * 8)], "g string, i int, text string")
    got = [(r["i"], r["decision"], r["final_tokens"]) for r in V.fit_budget(c, "g", "i", "text", 25).orderBy("i").collect()]
    assert got == [(1, "include", 10), (2, "exclude", 0), (3, "include", 10), (4, "include", 2)]


def test_windows_of_long_sections(spark):
    notes = "Notes\n" + " ".join(f"w{i}" for i in range(700))
    d = spark.createDataFrame([(1, "meeting_notes", notes), (2, "contract", "SECTION 2\n" + " ".join(f"v{i}" for i in range(1001)))], "doc_id long, source_type string, text string")
    got = {}
    for r in T.chunk(d).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["strategy"], r["content"].split()[0], len(r["content"].split())))
    assert got == {1: [("agenda_window", "w0", 600), ("agenda_window", "w500", 200)], 2: [("clause_window", "v0", 1000), ("clause_window", "v950", 51)]}
