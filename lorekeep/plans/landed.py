"""Queries on landed records of services and on single functions and detectors, over small built-in rows; the rows expected are written down."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import detectors as D
from ..operators import entities as E
from ..operators import retrieval as V
from ..sources import normalise as N
from . import samples as S
from .base import Literal, example, expected, q, quoted, table

# ------------------------------------------------------------------ mails and chats
_MAILS = [
    ("m1", "Plan", "<p>Hello&nbsp;all</p>  <b>see</b> plan", "Ann@X.com", ["bob@x.com", " ANN@x.com "], "t1", "2024-05-02T10:00:00Z", None), ("m2", "Re: Plan", "fine", "bob@x.com", None, "t1", "2024-05-01T10:00:00Z", None),
    ("m3", None, None, "c@y.org", [], "t2", "no date", None), ("m4", "Gone", "x", "d@y.org", [], "t2", "2024-05-03T10:00:00Z", "deleted"),
]


def _mails(spark):
    raw = spark.createDataFrame(_MAILS, "id string, subject string, body string, sender string, recipients array<string>, conversationId string, sentDateTime string, removed string")
    return N.mail(raw)


@example(expected("doc_id string; title string; body string; author string; participants array<string>; thread_id string; sent string", [
    ("mail-m1", "Plan", "Hello&nbsp;all see plan", "ann@x.com", ["ann@x.com", "bob@x.com"], "t1", "2024-05-02"), ("mail-m2", "Re: Plan", "fine", "bob@x.com", ["bob@x.com"], "t1", "2024-05-01"), ("mail-m3", None, None, "c@y.org", ["c@y.org"], "t2", None),
]))
def landed_mails(spark, sf):
    return _mails(spark).select("doc_id", "title", "body", "author", "participants", "thread_id", F.date_format("created_at", "yyyy-MM-dd").alias("sent"))


@example(expected("thread_id string; root string; children array<string>", [("t1", "mail-m2", ["mail-m1"]), ("t2", "mail-m3", [])]))
def landed_threads(spark, sf):
    return N.threads(_mails(spark))


@example(expected("mail_id string; name string; state string", [("m1", "a.pdf", "queued"), ("m1", "big.zip", "skipped_too_large")]))
def landed_attachments(spark, sf):
    rows = [("m1", [("a.pdf", 10, "file"), ("big.zip", 26214401, "file"), ("mail", 5, "item")]), ("m2", [])]
    return N.attachments(spark.createDataFrame(rows, "id string, attachments array<struct<name:string,size:long,kind:string>>")).select("mail_id", "name", "state")


@example(expected("id long; kept array<string>", [(1, ["Importance=high", "Message-ID=<1>"]), (2, [])]))
def kept_headers(spark, sf):
    rows = spark.createDataFrame([(1, [("Message-ID", "<1>"), ("Received", "x"), ("Importance", "high")]), (2, [])], "id long, headers array<struct<name:string,value:string>>")
    pairs = F.transform(F.map_entries(N.kept_headers(F.col("headers"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("id", F.array_sort(pairs).alias("kept"))


@example(expected("doc_id string; thread_id string; body string; sent string", [("chat-c1-1.5", "1.5", "hi", "1970-01-01 00:00:01"), ("chat-c1-3.0", "1.5", "answer", "1970-01-01 00:00:03")]))
def landed_chats(spark, sf):
    rows = [("1.5", "c1", "u1", "hi", "message", None, None), ("2.0", "c1", "u1", "joined", "message", "channel_join", None), ("3.0", "c1", "u2", "answer", "message", None, "1.5"), ("4.0", "c1", "u2", "x", "reaction", None, None)]
    d = N.chat(spark.createDataFrame(rows, "ts string, channel string, user string, text string, type string, subtype string, thread_ts string"))
    return d.select("doc_id", "thread_id", "body", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("sent"))


@example(expected("doc_id string; body string; author string; thread_id string", [("teams-1", "hello you", "ann", "1"), ("teams-2", "reply", "bob", "1")]))
def landed_team_messages(spark, sf):
    rows = [("1", "<div>hello <b>you</b></div>", "ann", None, "2024-05-01T00:00:00Z"), ("2", "reply", "bob", "1", None)]
    return N.team_message(spark.createDataFrame(rows, "id string, body string, `from` string, replyToId string, createdDateTime string")).select("doc_id", "body", "author", "thread_id")


# ------------------------------------------------------------------ pages, drives, notes
_PROPS = json.dumps({"Name": {"type": "title", "title": [{"plain_text": "My "}, {"plain_text": "page"}]}, "Tags": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, "N": {"type": "number", "number": 3.0}, "Rel": {"type": "relation", "relation": [{"id": "p9"}]}, "Odd": {"type": "rollup"}})


@example(expected("id string; title string; properties array<string>", [("p1", "My page", ["N=3", "Name=My page", "Odd=?", "Rel=p9", "Tags=a, b"]), ("p2", "Untitled", [])]))
def page_properties(spark, sf):
    rows = spark.createDataFrame([("p1", _PROPS), ("p2", "{}")], "id string, properties string")
    pairs = F.transform(F.map_entries(N.properties(F.col("properties"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?"))))
    return rows.select("id", N.page_title(F.col("properties")).alias("title"), F.array_sort(pairs).alias("properties"))


@example(expected("doc_id string; body string; edges array<string>", [("page-p1", "text\n\n--- Comments ---\n[Comment by ann]: good", ["child_of:up", "relates_to:Rel:p9"]), ("page-p2", None, ["record_in:db"])]))
def landed_pages(spark, sf):
    rows = [("p1", "t", "text", "up", None, None, _PROPS, [("ann", "good"), ("bob", "")]), ("p2", "u", None, None, "db", None, "{}", [])]
    d = N.page(spark.createDataFrame(rows, "id string, title string, content string, parent_id string, database_id string, last_edited string, properties string, comments array<struct<author:string,text:string>>"))
    return d.select("doc_id", "body", F.transform("relations", lambda r: F.concat_ws(":", r["type"], r["target"])).alias("edges"))


@example(expected("page_id string; content string", [("pg", "intro\n# Head\n- [x] done\n- point\n  deeper\n    ```py\nx = 1\n```\na | b\n---\n[IMAGE: cap]\n[Bookmark: http://x]")]))
def block_texts(spark, sf):
    rows = [
        ("b0", None, "pg", 0, "paragraph", "intro", None, None, None, None), ("b1", None, "pg", 1, "heading_1", "Head", None, None, None, None), ("b2", None, "pg", 2, "to_do", "done", True, None, None, None), ("b3", None, "pg", 3, "bulleted_list_item", "point", None, None, None, None),
        ("c0", "b3", "pg", 0, "quote", "deeper", None, None, None, None), ("d0", "c0", "pg", 0, "code", "x = 1", None, "py", None, None), ("b4", None, "pg", 4, "table_row", None, None, None, ["a", "b"], None), ("b5", None, "pg", 5, "divider", None, None, None, None, None),
        ("b6", None, "pg", 6, "image", "cap", None, None, None, None), ("b7", None, "pg", 7, "bookmark", None, None, None, None, "http://x"), ("b8", None, "pg", 8, "unheard_of", "x", None, None, None, None), ("b9", None, "pg", 9, "paragraph", "", None, None, None, None),
    ]
    return N.blocks_to_text(N.nested(spark.createDataFrame(rows, "block_id string, parent_id string, page_id string, pos int, type string, text string, checked boolean, language string, cells array<string>, url string")))


@example(expected("doc_id string; content_type string; edges long", [("drive-1", "document", 1), ("drive-3", "image", 0)]))
def landed_drive_files(spark, sf):
    rows = [("1", "a", "application/vnd.google-apps.document", "x", "f1", None, False), ("2", "b", "application/vnd.google-apps.folder", None, None, None, False), ("3", "c", "image/png", None, None, None, None), ("4", "d", "text/plain", "x", None, None, True)]
    d = N.drive_file(spark.createDataFrame(rows, "id string, name string, mimeType string, content string, parent string, modifiedTime string, trashed boolean"))
    return d.select("doc_id", "content_type", F.size("relations").cast("long").alias("edges"))


@example(
    """WITH RECURSIVE f(id, name, parent) AS (VALUES (1, 'root', NULL), (2, 'a', 1), (3, 'b', 2), (4, 'c', 1), (5, 'lost', 99)), r AS (SELECT id, name AS path FROM f WHERE parent IS NULL UNION ALL SELECT f.id, r.path || '/' || f.name FROM f JOIN r ON f.parent = r.id)
SELECT id::BIGINT AS id, path FROM r"""
)
def folder_paths(spark, sf):
    return N.folder_paths(spark.createDataFrame([(1, "root", None), (2, "a", 1), (3, "b", 2), (4, "c", 1), (5, "lost", 99)], "id long, name string, parent long"))


_NOTE = "---\ntitle: My note\ntags:\n  - one\n  - two\n---\n#big see [[Other#Part|x]], ![[img.png]] [due:: 2024] [due:: 2025]\n> [!note] mind"


@example(expected("title string; content_type string; edges array<string>; tags array<string>; embeds array<string>; callouts array<string>; front array<string>; due string", [
    ("2024-05-01", "daily_note", ["links_to:Other", "embeds:img.png"], ["big"], ["img.png"], ["note"], ["tags=one,two", "title=My note"], "2025"),
]))
def landed_notes(spark, sf):
    files = spark.createDataFrame([("v/2024-05-01.md", _NOTE, None)], "path string, content string, modified timestamp")
    marks = files.select(F.lit("2024-05-01").alias("title"), F.array_sort(F.transform(F.map_entries(N.front_matter(F.col("content"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("front"), N.dataview_fields(F.col("content"))["due"].alias("due"))
    d = N.note(files).select("title", "content_type", F.transform("relations", lambda r: F.concat_ws(":", r["type"], r["target"])).alias("edges"))
    return d.join(N.note_marks(files).select(F.lit("2024-05-01").alias("title"), "tags", "embeds", "callouts"), "title").join(marks, "title")


@example(expected("title string; body string; edges array<string>", [("board", "[Canvas]\nidea\n[Linked: n.md]", ["n.md"])]))
def landed_canvases(spark, sf):
    text = '{"nodes": [{"type": "text", "text": "idea"}, {"type": "file", "file": "n.md"}, {"type": "group"}]}'
    d = N.canvas(spark.createDataFrame([("v/board.canvas", text, None)], "path string, content string, modified timestamp"))
    return d.select("title", "body", F.transform("relations", lambda r: r["target"]).alias("edges"))


@example(expected("chunk_id string; payload string", [("k1", '{"n":3}'), ("k2", '{"title":"x","n":4}')]))
def chunk_payloads(spark, sf):
    return N.payload(spark.createDataFrame([("k1", None, 3), ("k2", "x", 4)], "chunk_id string, title string, n int"), "title", "n")


@q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def store_without_documents(spark, sf):
    """The documents that are left when those labelled toxic are removed."""
    return N.without_documents(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


# ------------------------------------------------------------------ functions
_ALL = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z0-9]+$')))"
_LONG = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 4))"


@q(
    f"""WITH {S.TEXTS.cte}, s AS (SELECT id, {_ALL.format("a")} AS x, {_ALL.format("b")} AS y, {_LONG.format("a")} AS u, {_LONG.format("b")} AS v FROM texts)
SELECT id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 9)::DOUBLE AS words, round(CASE WHEN len(u) > 0 AND len(v) > 0 THEN len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) ELSE 0 END, 9)::DOUBLE AS long_words FROM s"""
)
def word_likeness(spark, sf):
    t = S.TEXTS.frame(spark, sf)
    words = X.jaccard(F.array_distinct(X.tokens(F.col("a"))), F.array_distinct(X.tokens(F.col("b"))))
    return t.select("id", F.round(words, 9).alias("words"), F.round(X.jaccard(X.long_words(F.col("a")), X.long_words(F.col("b"))), 9).alias("long_words"))


@q(
    f"""WITH {S.TEXTS.cte}, h AS (SELECT id, a, a[:40] AS head FROM texts), p AS (SELECT *, length(head) - instr(reverse(head), '.') + 1 AS stop, contains(head, '.') AS has FROM h)
SELECT id, CASE WHEN length(a) <= 40 THEN a WHEN has AND stop - 1 > 20 THEN head[:stop] || ' …' ELSE head || ' …' END AS snippet, floor(length(a) / 4)::BIGINT AS tokens FROM p"""
)
def text_snippets(spark, sf):
    return S.TEXTS.frame(spark, sf).select("id", X.snippet(F.col("a"), 40).alias("snippet"), X.token_estimate(F.col("a")).alias("tokens"))


@q(
    f"""WITH {S.TEXTS.cte}, c AS (SELECT id, generate_subscripts(string_split(a[:128], ''), 1) - 1 AS i, unnest(string_split(a[:128], '')) AS ch FROM texts WHERE a <> ''), s AS (SELECT id, i % 64 AS k, sum(ascii(ch)) AS v FROM c GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)
SELECT id, round(max(v / norm), 9) AS largest, count(*) AS filled FROM s JOIN n USING (id) GROUP BY 1"""
)
def stub_embeddings(spark, sf):
    v = S.TEXTS.frame(spark, sf).where("a <> ''").select("id", X.stub_embedding(F.col("a")).alias("v"))
    return v.select("id", F.round(F.array_max("v"), 9).alias("largest"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("filled"))


@example(expected("name string; key string; full_name string", [("Acmé Holdings Ltd.", "acme", "acme"), ("Borealis Power Pvt Ltd", "borealis power", "borealis"), ("bob", "bob", "robert"), ("李雷 Group", "李雷", "李雷")]))
def company_keys(spark, sf):
    rows = spark.createDataFrame([("Acmé Holdings Ltd.",), ("Borealis Power Pvt Ltd",), ("bob",), ("李雷 Group",)], "name string")
    key = X.company_key(F.col("name"))
    return rows.select("name", key.alias("key"), X.same_first_name(F.split(key, " ")[0]).alias("full_name"))


# ------------------------------------------------------------------ detectors, conflicts, persons
@q(
    f"""WITH {S.TALK.cte}, n AS (SELECT company, count(*) AS n_negative FROM talk WHERE said_at >= TIMESTAMP '2024-05-01' AND ({" OR ".join(f"regexp_matches(lower(text), {quoted(p)})" for p in D.C.NEGATIVE_WORDS)}) GROUP BY 1)
SELECT company, n_negative, CASE WHEN n_negative >= 5 THEN 'high' ELSE 'medium' END AS severity FROM n WHERE n_negative >= 3"""
)
def negative_patterns(spark, sf):
    """Companies whose messages of the last 14 days sound bad."""
    recent = S.TALK.frame(spark, sf).where(F.datediff(F.lit("2024-05-15").cast("date"), F.col("said_at")) <= 14)
    return D.negative_pattern(recent, "company", "text")


@q("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-01')::INT AS drift_days, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') >= 30 THEN 'critical' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') >= 14 THEN 'high' ELSE 'medium' END AS severity FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '1998-01-01') >= 7")
def project_drift(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    return D.drift(o, "o_orderdate", F.lit("1998-01-01").cast("date")).select("o_orderkey", "drift_days", "severity")


_SAID = Literal("said", "g long; text string", [(1, "approved and completed"), (1, "REJECTED, still pending"), (2, "no risk here"), (2, "fine"), (3, "approved"), (3, "approved again"), (4, "")])


@q(_SAID.dealt("g long; conflicts array<int>", [(1, [0, 1]), (2, [3])]))
def conflicting_texts(spark, sf):
    return V.conflicts(_SAID.over(spark, sf), "g", "text")


_MENTIONS = Literal("mentions", "mention_id long; name string; email string", [(1, "whoever", " JS@x.com"), (2, "Bobby B", None), (3, "X. Smith", None), (4, "Bob Brown", ""), (5, "Nobody Known", None), (6, "?!", None), (7, "Петров Иван", None)])


@q(_MENTIONS.dealt("mention_id long; entity_id long; stage string; score double", [(1, 10, "email", 1.0), (2, 11, "alias", 0.9), (3, 10, "fuzzy", 0.9), (4, 11, "fuzzy", 1.0), (7, 12, "fuzzy", 1.0)]))
def resolved_persons(spark, sf):
    m = _MENTIONS.over(spark, sf)
    ents = spark.createDataFrame([(10, "Xavier Smith", "js@x.com"), (11, "Robert Brown", None), (12, "Иван Петров", ""), (13, "...", "")], "entity_id long, name string, email string")
    aliases = E.register_aliases(spark.createDataFrame([("bobby b", 11, 0.9)], "alias string, entity_id long, confidence double"), spark.createDataFrame([("Bobby  B", 10, 0.5)], "alias string, entity_id long, confidence double"))
    return E.resolve(m, ents, aliases).withColumn("score", F.round("score", 6))
