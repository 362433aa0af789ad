"""Line dedup beside groups of copies."""

from lorekeep.llm import line_dedup


def test_copies_of_a_document_keep_their_text(spark):
    story = "a line of prose told once\nand its second line"
    rows = [(i, "s", f"page {i}\nhome | about | contact") for i in range(300)] + [(300 + i, "s", story) for i in range(8)] + [(400, "s", None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(d).collect()}
    assert got == {i: None if t is None else t.replace("\nhome | about | contact", "") for i, _, t in rows}
    found = line_dedup.boilerplate(d).collect()
    assert [(r["pages"], r["host_pages"]) for r in found] == [(300, 302)]
