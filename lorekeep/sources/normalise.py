"""Landed raw records of each service -> one document model. Pull loops land JSON; Spark reads it.

Documents: doc_id, source, content_type, title, body, author, participants (array), thread_id,
created_at, relations (array of type and target), content_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X

FIELDS = ("doc_id", "source", "content_type", "title", "body", "author", "participants", "thread_id", "created_at", "relations", "content_hash")
RELATION = "array<struct<type:string,target:string>>"
#: Internet headers that are kept.
KEPT_HEADERS = ["Message-ID", "In-Reply-To", "References", "X-Priority", "Importance"]
MAX_ATTACHMENT = 25 * 1024 * 1024


def _document(rows: DataFrame, **cols: Column) -> DataFrame:
    out = {"thread_id": F.lit(None).cast("string"), "participants": F.array().cast("array<string>"), "relations": F.array().cast(RELATION), "author": F.lit(None).cast("string"), "title": F.lit(None).cast("string")} | cols
    out["content_hash"] = X.content_hash(F.coalesce(out["body"], F.lit("")))
    return rows.select(*[out[f].alias(f) for f in FIELDS])


def mail(raw: DataFrame) -> DataFrame:
    """id, subject, body, sender, recipients, conversationId, sentDateTime; removed items of delta feeds are skipped."""
    rows = raw.where(F.col("removed").isNull()) if "removed" in raw.columns else raw
    people = F.array_distinct(F.transform(F.concat(F.array("sender"), F.coalesce("recipients", F.array())), X.normalise_email))
    return _document(rows, doc_id=F.concat(F.lit("mail-"), F.col("id")), source=F.lit("outlook"), content_type=F.lit("email"), title=F.col("subject"), body=X.strip_html(F.col("body")), author=X.normalise_email(F.col("sender")), participants=people, thread_id=F.col("conversationId"), created_at=F.try_to_timestamp("sentDateTime"))


def threads(mails: DataFrame) -> DataFrame:
    """thread_id, root, children in order of sending."""
    g = mails.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "doc_id"))).alias("m"))
    return g.select("thread_id", F.col("m")[0]["doc_id"].alias("root"), F.transform(F.slice("m", F.lit(2), F.size("m")), lambda x: x["doc_id"]).alias("children"))


def attachments(raw: DataFrame) -> DataFrame:
    """A row per attachment with its state; items attached as such are skipped."""
    rows = raw.select(F.col("id").alias("mail_id"), F.explode("attachments").alias("a")).where("a.kind <> 'item'")
    return rows.select("mail_id", F.col("a.name").alias("name"), F.col("a.size").alias("size"), F.when(F.col("a.size") > MAX_ATTACHMENT, "skipped_too_large").otherwise("queued").alias("state"))


def kept_headers(headers: Column) -> Column:
    """array of struct(name, value) -> map of the kept ones."""
    return F.map_from_entries(F.filter(headers, lambda h: h["name"].isin(KEPT_HEADERS)))


def chat(raw: DataFrame) -> DataFrame:
    """ts, channel, user, text, type, subtype; plain messages only."""
    rows = raw.where((F.col("type") == "message") & F.col("subtype").isNull())
    return _document(rows, doc_id=F.concat_ws("-", F.lit("chat"), "channel", "ts"), source=F.lit("slack"), content_type=F.lit("chat"), body=F.col("text"), author=F.col("user"), thread_id=F.coalesce("thread_ts", "ts"), created_at=F.timestamp_seconds(F.col("ts").cast("double")))


def team_message(raw: DataFrame) -> DataFrame:
    return _document(raw, doc_id=F.concat(F.lit("teams-"), F.col("id")), source=F.lit("teams"), content_type=F.lit("chat"), body=X.strip_html(F.col("body")), author=F.col("from"), thread_id=F.coalesce("replyToId", "id"), created_at=F.try_to_timestamp("createdDateTime"))


#: A property of a page, as far as any of its types has it.
_PLAIN, _NAMED, _KEYED = "array<struct<plain_text:string>>", "struct<name:string>", "array<struct<id:string>>"
PROPERTY = f"struct<type:string,title:{_PLAIN},rich_text:{_PLAIN},select:{_NAMED},status:{_NAMED},multi_select:array<{_NAMED}>,date:struct<start:string>,checkbox:boolean,number:double,url:string,email:string,phone_number:string,people:{_KEYED},relation:{_KEYED},formula:struct<type:string,string:string,number:double,boolean:boolean>>"


def _said(rich: Column) -> Column:
    return F.array_join(F.transform(rich, lambda r: F.coalesce(r["plain_text"], F.lit(""))), "")


def properties(json: Column) -> Column:
    """A page's properties (JSON) as name -> text, for the 14 types that have one; lists are joined by commas, numbers without a
    fraction lose it."""
    number = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))

    def flat(_, v):
        kind, f = v["type"], v["formula"]
        many = lambda c, k: F.array_join(F.transform(v[c], lambda x: x[k]), ", ")
        formula = F.when(f["type"] == "number", number(f["number"])).when(f["type"] == "boolean", f["boolean"].cast("string")).otherwise(f["string"])
        out = F.lit(None).cast("string")
        for name, value in {
            "title": _said(v["title"]), "rich_text": _said(v["rich_text"]), "select": v["select"]["name"], "status": v["status"]["name"], "multi_select": many("multi_select", "name"), "date": v["date"]["start"],
            "checkbox": v["checkbox"].cast("string"), "number": number(v["number"]), "url": v["url"], "email": v["email"], "phone_number": v["phone_number"], "people": many("people", "id"), "relation": many("relation", "id"), "formula": formula,
        }.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    return F.transform_values(F.from_json(json, f"map<string,{PROPERTY}>"), flat)


def page_title(json: Column) -> Column:
    """The text of the property of type title, else 'Untitled'."""
    titles = F.filter(F.map_values(F.from_json(json, f"map<string,{PROPERTY}>")), lambda v: v["type"] == "title")
    return F.coalesce(F.nullif(_said(F.get(titles, 0)["title"]), F.lit("")), F.lit("Untitled"))


def page(raw: DataFrame) -> DataFrame:
    """id, title, content, parent_id, database_id, last_edited, and if given properties (JSON) and comments (array of author, text):
    edges to parent, database and related pages; comments are appended."""
    edges = F.filter(F.array(F.struct(F.lit("child_of").alias("type"), F.col("parent_id").alias("target")), F.struct(F.lit("record_in").alias("type"), F.col("database_id").alias("target"))), lambda e: e["target"].isNotNull())
    body = F.col("content")
    if "properties" in raw.columns:
        props = F.filter(F.map_entries(F.from_json("properties", f"map<string,{PROPERTY}>")), lambda e: e["value"]["type"] == "relation")
        linked = F.flatten(F.transform(props, lambda e: F.transform(e["value"]["relation"], lambda r: F.struct(F.concat(F.lit("relates_to:"), e["key"]).alias("type"), r["id"].alias("target")))))
        edges = F.concat(edges, F.coalesce(linked, F.array().cast(RELATION)))
    if "comments" in raw.columns:
        said = F.transform(F.filter("comments", lambda c: c["text"] != ""), lambda c: F.concat(F.lit("[Comment by "), F.coalesce(c["author"], F.lit("unknown")), F.lit("]: "), c["text"]))
        body = F.when(F.size(said) > 0, F.concat(F.coalesce(body, F.lit("")), F.lit("\n\n--- Comments ---\n"), F.array_join(said, "\n"))).otherwise(body)
    return _document(raw, doc_id=F.concat(F.lit("page-"), F.col("id")), source=F.lit("notion"), content_type=F.lit("page"), title=F.col("title"), body=body, relations=edges, created_at=F.try_to_timestamp("last_edited"))


def database(raw: DataFrame, records: DataFrame, most: int = 100) -> DataFrame:
    """id, title, schema (map name -> type), last_edited with its records (id, database_id): schema and count as text, edges to the
    first records by id."""
    rank = F.row_number().over(Window.partitionBy("database_id").orderBy("id"))
    n = records.groupBy("database_id").agg(F.count(F.lit(1)).alias("_n"))
    first = records.withColumn("_r", rank).where(F.col("_r") <= most).groupBy("database_id").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    rows = raw.join(n, raw["id"] == n["database_id"], "left").drop("database_id").join(first, F.col("id") == first["database_id"], "left").drop("database_id")
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("schema")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n")
    body = F.concat(F.lit("Database: "), "title", F.lit("\n\nSchema:\n"), fields, F.lit("\n\nRecords: "), F.coalesce("_n", F.lit(0)).cast("string"))
    edges = F.transform(F.coalesce("_ids", F.array().cast("array<string>")), lambda i: F.struct(F.lit("has_record").alias("type"), i.alias("target")))
    return _document(rows, doc_id=F.concat(F.lit("page-"), F.col("id")), source=F.lit("notion"), content_type=F.lit("database_record"), title=F.col("title"), body=body, relations=edges, created_at=F.try_to_timestamp("last_edited"))


def edited_since(raw: DataFrame, since: Column, ts: str = "last_edited") -> DataFrame:
    """What was edited at or after `since`; what has no readable time stays."""
    at = F.try_to_timestamp(F.col(ts))
    return raw.where(at.isNull() | (at >= since))


def nested(blocks: DataFrame, depth: int = 5) -> DataFrame:
    """block_id, parent_id, page_id, pos, ... -> with depth and path (the positions from the page down), by at most `depth` joins."""
    level = blocks.where("parent_id is null").withColumns({"depth": F.lit(0), "path": F.array("pos")})
    out = level
    for d in range(1, depth):
        up = level.select(F.col("block_id").alias("parent_id"), F.col("path").alias("_up"))
        level = blocks.join(up, "parent_id").withColumns({"depth": F.lit(d), "path": F.concat("_up", F.array("pos"))}).drop("_up").select(*out.columns)
        out = out.unionByName(level)
    return out


#: Service types that are exported or downloaded, and as what.
EXPORTS = {
    "application/vnd.google-apps.document": "document", "application/vnd.google-apps.spreadsheet": "spreadsheet", "application/vnd.google-apps.presentation": "presentation", "application/vnd.google-apps.drawing": "pdf", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "spreadsheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "presentation",
    "application/msword": "document", "application/vnd.ms-excel": "spreadsheet", "application/vnd.ms-powerpoint": "presentation", "text/plain": "text", "text/csv": "csv", "text/markdown": "text", "image/png": "image", "image/jpeg": "image", "image/gif": "image", "image/webp": "image",
}


def drive_file(raw: DataFrame) -> DataFrame:
    """id, name, mimeType, content, parent, modifiedTime, trashed; folders, removed and unsupported files are skipped."""
    kind = F.create_map(*[F.lit(x) for kv in EXPORTS.items() for x in kv])[F.col("mimeType")]
    rows = raw.where(~F.coalesce("trashed", F.lit(False))).withColumn("_k", kind).where("_k is not null")
    edge = F.when(F.col("parent").isNotNull(), F.array(F.struct(F.lit("in_folder").alias("type"), F.col("parent").alias("target")))).otherwise(F.array().cast(RELATION))
    return _document(rows, doc_id=F.concat(F.lit("drive-"), F.col("id")), source=F.lit("drive"), content_type=F.col("_k"), title=F.col("name"), body=F.col("content"), relations=edge, created_at=F.try_to_timestamp("modifiedTime"))


def folder_paths(folders: DataFrame, depth: int = 10) -> DataFrame:
    """id, name, parent -> id, path, by at most `depth` joins."""
    paths = folders.where("parent is null").select("id", F.col("name").alias("path"))
    level = paths
    for _ in range(depth - 1):
        level = folders.join(level.select(F.col("id").alias("parent"), "path"), "parent").select("id", F.concat_ws("/", "path", "name").alias("path"))
        paths = paths.unionByName(level)
    return paths


def note(files: DataFrame) -> DataFrame:
    """path, content of Markdown notes: front matter off, wiki links and embeds as relations."""
    text = F.col("content")
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    edges = lambda pattern, kind: F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), 1)), lambda t: F.struct(F.lit(kind).alias("type"), F.trim(t).alias("target")))
    links = F.concat(edges(r"(?<!!)\[\[([^\[\]|#]+)(?:#[^\[\]|]+)?(?:\|[^\[\]]+)?\]\]", "links_to"), edges(r"!\[\[([^\[\]]+)\]\]", "embeds"))
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return _document(files, doc_id=F.concat(F.lit("note-"), F.md5("path")), source=F.lit("obsidian"), content_type=F.when(name.rlike(r"^\d{4}-\d{2}-\d{2}$"), "daily_note").otherwise("note"), title=name, body=body, relations=links, created_at=F.col("modified"))


def front_matter(content: Column) -> Column:
    """The plain `key: value` lines and `- item` lists of a note's front matter as name -> text, lists joined by commas."""
    head = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---\n", 1)
    joined = F.regexp_replace(F.regexp_replace(head, r"(?m)\n\s*-\s+", ","), r"(?m):\s*,", ": ")
    pairs = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^[^\s:#][^:]*:"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"'\\[]|[\"'\\]]$", "")
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), value(x).alias("v")))))


def dataview_fields(content: Column) -> Column:
    """Inline [name:: value] fields; the last of a name counts."""
    pattern = r"\[([^\[\]]+)::\s*([^\[\]]+)\]"
    names, values = (F.transform(F.regexp_extract_all(content, F.lit(pattern), k), lambda x: F.trim(x)) for k in (1, 2))
    both = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(both, lambda x, i: F.array_position(F.transform(F.slice(both, i + 2, F.size(both)), lambda y: y["k"]), x["k"]) == 0)
    return F.map_from_entries(last)


def canvas(files: DataFrame) -> DataFrame:
    """path, content (JSON), modified of canvases: text nodes as they are, file nodes as links and relations."""
    nodes = F.from_json("content", "struct<nodes:array<struct<type:string,text:string,file:string>>>")["nodes"]
    line = lambda n: F.when(n["type"] == "text", F.coalesce(n["text"], F.lit(""))).when(n["type"] == "file", F.concat(F.lit("[Linked: "), F.coalesce(n["file"], F.lit("")), F.lit("]")))
    body = F.concat_ws("\n", F.lit("[Canvas]"), F.array_join(F.array_compact(F.transform(F.coalesce(nodes, F.array().cast("array<struct<type:string,text:string,file:string>>")), line)), "\n"))
    links = F.transform(F.filter(F.coalesce(nodes, F.array().cast("array<struct<type:string,text:string,file:string>>")), lambda n: n["type"] == "file"), lambda n: F.struct(F.lit("canvas_references").alias("type"), n["file"].alias("target")))
    return _document(files, doc_id=F.concat(F.lit("note-"), F.md5("path")), source=F.lit("obsidian"), content_type=F.lit("note"), title=F.regexp_extract("path", r"([^/]+)\.canvas$", 1), body=body, relations=links, created_at=F.col("modified"))


def local_file(files: DataFrame) -> DataFrame:
    """path, content (text), modified of parsed files of any kind."""
    return _document(files, doc_id=F.concat(F.lit("file-"), F.md5("path")), source=F.lit("local"), content_type=F.lit("document"), title=F.regexp_extract("path", r"([^/]+)$", 1), body=F.col("content"), created_at=F.col("modified"))


def attachment_file(files: DataFrame) -> DataFrame:
    """path, modified of a vault's attachments: no text, only that they are there."""
    return _document(files, doc_id=F.concat(F.lit("note-"), F.md5("path")), source=F.lit("obsidian"), content_type=F.lit("attachment"), title=F.regexp_extract("path", r"([^/]+)$", 1), body=F.lit(""), created_at=F.col("modified"))


def looked_back(raw: DataFrame, ts: Column, as_of: Column, days: int = 30) -> DataFrame:
    """What a first run takes: records of the last `days`."""
    return raw.where(ts >= F.timestamp_seconds(F.unix_timestamp(as_of.cast("timestamp")) - days * 86400))


def payload(chunks: DataFrame, *columns: str) -> DataFrame:
    """chunk_id, payload: the columns as JSON without the nulls, as they go to a vector store."""
    return chunks.select("chunk_id", F.to_json(F.struct(*columns)).alias("payload"))


def without_documents(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a store without those of documents that were removed."""
    return stored.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def note_marks(files: DataFrame) -> DataFrame:
    """Tags, embeds and callouts of notes."""
    t = F.col("content")
    return files.select("path", F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), 1))).alias("tags"), F.regexp_extract_all(t, F.lit(r"!\[\[([^\]]+)\]\]"), 1).alias("embeds"), F.regexp_extract_all(t, F.lit(r"(?m)^>\s*\[!(\w+)\]"), 1).alias("callouts"))


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """page_id, pos or path, depth, type, text, checked, and if given language, cells (array), url -> page_id, content: a line per
    block in order, indented by depth, for 16 types; blocks of other types and empty paragraphs give no line."""
    have = lambda c, kind="string": F.col(c) if c in blocks.columns else F.lit(None).cast(kind)
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    ticked = F.coalesce(F.col("checked"), F.lit(False))
    shown = (
        F.when(kind.isin("paragraph", "quote", "callout"), F.nullif(text, F.lit("")))
        .when(kind.rlike("^heading_[1-9]$"), F.concat(F.repeat(F.lit("#"), F.substring(kind, -1, 1).cast("int")), F.lit(" "), text))
        .when(kind.isin("bulleted_list_item", "numbered_list_item", "to_do"), F.concat(F.when(ticked, "- [x] ").when(kind == "to_do", "- [ ] ").otherwise("- "), text))
        .when(kind == "toggle", F.concat(F.lit("\u25b6 "), text))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(have("language"), F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(kind == "table", "[Table]")
        .when(kind == "table_row", F.array_join(F.coalesce(have("cells", "array<string>"), F.array().cast("array<string>")), " | "))
        .when(kind == "divider", "---")
        .when(kind.isin("image", "file", "pdf"), F.concat(F.lit("["), F.upper(kind), F.lit(": "), text, F.lit("]")))
        .when(kind == "bookmark", F.concat(F.lit("[Bookmark: "), F.coalesce(have("url"), F.lit("")), F.lit("]")))
    )
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), shown)
    order = F.col("path") if "path" in blocks.columns else F.col("pos")
    g = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(order.alias("at"), line.alias("line"))))).alias("l"))
    return g.select("page_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
