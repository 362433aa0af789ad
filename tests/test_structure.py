"""Documents and slides as ordered parts."""

import io
import zipfile

from pyspark.sql import functions as F

from lorekeep.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
CORE = '<c xmlns:dc="d" xmlns:cp="e"><dc:title>My plan</dc:title><dc:creator>Ann</dc:creator><cp:keywords/></c>'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def para(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = packed(**{
    "docProps__core.xml": CORE,
    "word__document.xml": f"<w:document {W}><w:body>{para('Plan', 'Title')}{para('Before')}{para('One', 'Heading2')}{para('in one')}{para('Deep', 'Heading3')}<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr><w:tr><w:tc>{para('1')}</w:tc><w:tc>{para('')}</w:tc></w:tr></w:tbl>{para('Two', 'Heading2')}<w:sdt><w:sdtContent>{para('inside')}</w:sdtContent></w:sdt>{para('')}</w:body></w:document>",
})
PPTX = packed(**{
    "ppt__slides__slide10.xml": f"<sld {A}><a:p><a:r><a:t>Last</a:t></a:r></a:p></sld>", "ppt__slides__slide2.xml": f"<sld {A}><a:p><a:r><a:t>Hello</a:t></a:r></a:p><a:p><a:r><a:t>point</a:t></a:r></a:p></sld>",
    "ppt__slides___rels__slide2.xml.rels": '<R><r Type="http://x/notesSlide" Target="../notesSlides/notesSlide1.xml"/></R>', "ppt__notesSlides__notesSlide1.xml": f"<sld {A}><a:p><a:r><a:t>say this</a:t></a:r></a:p></sld>",
})


def test_parts_in_order(spark):
    rows = spark.createDataFrame([("a.docx", None, DOCX), ("b.bin", "application/vnd.openxmlformats-officedocument.presentationml.presentation", PPTX), ("c.docx", None, b"no zip"), ("d.txt", None, b"x")], "path string, mime string, content binary")
    got = {r["path"]: r for r in files.structured(rows).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"a.docx": "success", "b.bin": "success", "c.docx": "failed", "d.txt": "unsupported"}
    assert [tuple(p) for p in got["a.docx"]["parts"]] == [
        ("heading", 1, "", "Plan"), ("text", 0, "Plan", "Before"), ("heading", 2, "Plan", "One"), ("text", 0, "Plan / One", "in one"), ("heading", 3, "Plan / One", "Deep"),
        ("row", 0, "Plan / One / Deep", "a | b"), ("row", 0, "Plan / One / Deep", "1 | "), ("heading", 2, "Plan", "Two"), ("text", 0, "Plan / Two", "inside"),
    ]
    assert got["a.docx"]["properties"] == {"title": "My plan", "creator": "Ann"}
    assert [tuple(p) for p in got["b.bin"]["parts"]] == [("slide", 2, "Hello", "Hello\npoint"), ("notes", 2, "Hello", "say this"), ("slide", 10, "Last", "Last")]
    assert got["c.docx"]["parts"] == []


def test_kind_by_mime_and_long_sheets(spark):
    lines = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(files.SHEET_ROWS + 5))
    sheet = packed(**{"xl__worksheets__sheet1.xml": f'<w xmlns="x"><d>{lines}</d></w>'})
    rows = spark.createDataFrame([("a.bin", "text/plain", b"hi"), ("b.txt", None, b"ho"), ("c.xlsx", "", sheet)], "path string, mime string, content binary")
    got = {r["path"]: (r["kind"], r["status"], r["text"][:2]) for r in files.parsed(rows).collect()}
    assert got == {"a.bin": ("text", "success", "hi"), "b.txt": ("text", "success", "ho"), "c.xlsx": ("xlsx", "partial", "0\n")}
    assert files.parsed(rows.drop("mime").withColumn("x", F.lit(1))).where("kind = 'unknown'").count() == 1
