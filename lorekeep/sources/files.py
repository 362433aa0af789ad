"""Files to text: routed by suffix, parsed in Arrow batches with the standard library; others are marked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET_ROWS = 10_000
SCHEMA = "path string, kind string, status string, title string, text string, n_parts int"
#: Suffix -> kind.
KINDS = {"txt": "text", "md": "text", "log": "text", "csv": "csv", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "html": "html", "htm": "html"}


#: MIME type -> kind, asked before the suffix; folders of a vault that are skipped, and what its files are.
MIME_KINDS = {
    "text/plain": "text", "text/markdown": "text", "text/csv": "csv", "text/html": "html", "application/pdf": "pdf", "image/png": "image", "image/jpeg": "image", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
SKIPPED_FOLDERS = [".obsidian", ".git", ".trash", ".DS_Store", "node_modules"]
VAULT_KINDS = {"md": "note", "markdown": "note", "canvas": "canvas", "png": "attachment", "jpg": "attachment", "jpeg": "attachment", "gif": "attachment", "webp": "attachment", "svg": "attachment", "pdf": "attachment", "mp3": "attachment", "mp4": "attachment", "docx": "attachment", "xlsx": "attachment"}


def kind_of(path: Column, mime: Column | None = None) -> Column:
    """A file's kind by its MIME type if that is known, else by its suffix, else 'unknown'."""
    lookup = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    by_suffix = lookup(KINDS, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return F.coalesce(by_suffix if mime is None else F.coalesce(lookup(MIME_KINDS, F.lower(mime)), by_suffix), F.lit("unknown"))


def vault(found: DataFrame, root: str = "") -> DataFrame:
    """Files (path, ...) of a vault that are notes, canvases or attachments, with vault_kind; what lies in skipped folders goes."""
    inside = F.expr(f"substring(path, {len(root) + 1})")
    skipped = F.exists(F.split(inside, "/"), lambda part: part.isin(*SKIPPED_FOLDERS))
    kind = F.create_map(*[F.lit(x) for kv in VAULT_KINDS.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    return found.where(~skipped).withColumn("vault_kind", kind).where("vault_kind is not null")


def files(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(path)


def parse(kind: str, data: bytes) -> tuple[str, str | None, str, int]:
    """status, title, text, parts."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    def strings(xml: bytes, tag: str) -> list[str]:
        return [x.text or "" for x in ElementTree.fromstring(xml).iter() if x.tag.endswith("}" + tag)]

    try:
        if kind in ("text", "csv"):
            text = data.decode("utf-8", "replace")
            return "success", None, text, text.count("\n") + (not text.endswith("\n")) if text else 0
        if kind == "html":
            text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", data.decode("utf-8", "replace"))).strip()
            return "success", None, text, 1
        if kind == "image":
            size = f"{int.from_bytes(data[16:20], 'big')}x{int.from_bytes(data[20:24], 'big')}" if data[:8] == b"\x89PNG\r\n\x1a\n" else ""
            return "success", size or None, "", 0
        if kind == "docx":
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
            paras = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")]
            kept = [p for p in paras if p.strip()]
            return "success", kept[0] if kept else None, "\n".join(kept), len(kept)
        if kind == "pptx":
            z = zipfile.ZipFile(io.BytesIO(data))
            names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            slides = [" ".join(s for s in strings(z.read(n), "t") if s.strip()) for n in names]
            return "success", slides[0] if slides else None, "\n".join(slides), len(slides)
        if kind == "xlsx":
            z = zipfile.ZipFile(io.BytesIO(data))
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
                shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in root]
            lines = []
            for n in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.endswith("}row")):
                    cells = []
                    for c in row:
                        v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                        cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                    if any(cells):
                        if len(lines) > SHEET_ROWS:  # a sheet that goes on is marked
                            return "partial", None, "\n".join(lines), len(lines)
                        lines.append("\t".join(cells))
            return "success", None, "\n".join(lines), len(lines)
        if kind == "pdf":
            return "partial", None, "", 0
    except Exception as e:  # one bad file is a marked row, not a failed job
        return "failed", None, str(e)[:200], 0
    return "failed", None, "", 0


def parsed(rows: DataFrame) -> DataFrame:
    """binaryFile rows, with a MIME type in a column `mime` where it is known -> path, kind, status, title, text, n_parts."""
    kind = kind_of(F.col("path"), F.col("mime") if "mime" in rows.columns else None)
    routed = rows.select("path", kind.alias("kind"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, k, *parse(k, bytes(c))) for p, k, c in zip(b["path"], b["kind"], b["content"])]
            yield pd.DataFrame(out, columns=["path", "kind", "status", "title", "text", "n_parts"])

    return routed.mapInPandas(run, SCHEMA)


def _heading(style: str | None) -> int:
    """The level of a paragraph style: 1 to 9 for headings, 1 for titles, 0 for text."""
    import re

    found = re.fullmatch(r"heading\s*(\d)", (style or "").lower())
    return int(found[1]) if found else int((style or "").lower() == "title")


def structure(kind: str, data: bytes) -> tuple[list[tuple], dict[str, str]]:
    """Parts in order (kind: heading, text, row, slide or notes; level; section: the headings above, joined by " / "; text) and the
    core properties of a docx or pptx file; nothing of other kinds."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    name = lambda x: x.tag.rpartition("}")[2]
    said = lambda x: "".join({"t": t.text or "", "tab": "\t", "br": "\n"}.get(name(t), "") for t in x.iter())
    if kind not in ("docx", "pptx"):
        return [], {}
    z = zipfile.ZipFile(io.BytesIO(data))
    core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    properties = {name(x): x.text for x in core if x.text}
    parts: list[tuple] = []
    if kind == "docx":
        above: list[tuple[int, str]] = []
        section = lambda: " / ".join(t for _, t in above)

        def walk(body):
            for x in body:
                if name(x) == "p":
                    text = said(x).strip()
                    level = _heading(next((v for s in x.iter() if name(s) == "pStyle" for a, v in s.attrib.items() if a.endswith("}val")), None))
                    if text and level:
                        while above and above[-1][0] >= level:
                            above.pop()
                        parts.append(("heading", level, section(), text))
                        above.append((level, text))
                    elif text:
                        parts.append(("text", 0, section(), text))
                elif name(x) == "tbl":
                    for row in (r for r in x if name(r) == "tr"):
                        parts.append(("row", 0, section(), " | ".join(said(c).strip() for c in row if name(c) == "tc")))
                elif name(x) in ("sdt", "sdtContent"):
                    walk(x)

        walk(next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if name(x) == "body"))
    else:
        number = lambda n: int(re.findall(r"\d+", n)[-1])
        for n in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            lines = [said(p).strip() for p in ElementTree.fromstring(z.read(n)).iter() if name(p) == "p"]
            lines = [x for x in lines if x]
            title = lines[0] if lines else ""
            parts.append(("slide", number(n), title, "\n".join(lines)))
            links = f"ppt/slides/_rels/slide{number(n)}.xml.rels"
            for link in ElementTree.fromstring(z.read(links)) if links in z.namelist() else []:
                notes = "ppt/" + link.get("Target", "").removeprefix("../")
                if "notesSlide" in link.get("Type", "") and notes in z.namelist():
                    text = "\n".join(x for x in (said(p).strip() for p in ElementTree.fromstring(z.read(notes)).iter() if name(p) == "p") if x)
                    if text:
                        parts.append(("notes", number(n), title, text))
    return parts, properties


def structured(rows: DataFrame) -> DataFrame:
    """binaryFile rows (with `mime` where known) -> path, status, properties, parts: the tree of a document in order, a part being kind,
    level, section and text. Files that can't be read are 'failed', other kinds 'unsupported'."""
    schema = "path string, status string, properties map<string,string>, parts array<struct<kind:string,level:int,section:string,text:string>>"
    kind = kind_of(F.col("path"), F.col("mime") if "mime" in rows.columns else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, k, content in zip(b["path"], b["kind"], b["content"]):
                try:
                    parts, told = structure(k, bytes(content))
                    status = "success" if k in ("docx", "pptx") else "unsupported"
                except Exception:  # one bad file is a marked row, not a failed job
                    parts, told, status = [], {}, "failed"
                out.append((path, status, told, [dict(zip(("kind", "level", "section", "text"), p)) for p in parts]))
            yield pd.DataFrame(out, columns=["path", "status", "properties", "parts"])

    return rows.select("path", kind.alias("kind"), "content").mapInPandas(run, schema)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)
