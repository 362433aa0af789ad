"""Line dedup by site-relative frequency, with DataFrame functions only.

Rows are grouped by host. For each line, the pages of the host that hold it are counted and divided
by the host's pages; lines found on at least `least_pages` pages and on more than `ratio` of them
are boilerplate there and are dropped from every page of the host. A host has at most
(lines per page / ratio) such lines, so they travel as one array per host; lines are told apart by
two independent 64-bit hashes. Pages of a host with equal texts count once, in its pages as well as
in a line's, so a repeated document is left to the near-duplicate stage. Counts are of distinct lines
per text and are summed before the last shuffle, so neither a common line nor a large host is one
task's work.

Edge cases: a null text stays null and counts as a page without lines; lines without a word are
never dropped; rows with a null host form one group; a page of boilerplate alone becomes an empty
text; repeated rows are equal texts; an empty table gives an empty result; further columns pass
through `drop_boilerplate`, but input columns named n_lines or n_dropped are replaced. Names starting
with `_lk_` are reserved. A line is looked up in its host's list from the start, so a host's longest
list (lines a page / ratio) is the most a line costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

RATIO = 0.005
LEAST_PAGES = 3
#: A table of boilerplate lines of at most so many rows is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000

#: A word of the texts: anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]"


def _hashed(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("lorekeep"), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_lk_host, _lk_a, _lk_b, pages, host_pages for each boilerplate line."""
    worded = F.filter(_lines(F.col(text)), lambda x: x.rlike(WORD))
    lines = docs.select(F.col(host).alias("_lk_host"), _hashed(F.col(text)).alias("_lk_t"), F.explode(F.array_distinct(F.transform(worded, _hashed))).alias("_lk_h"))
    once = lines.select("_lk_host", F.col("_lk_h.a").alias("_lk_a"), F.col("_lk_h.b").alias("_lk_b"), F.col("_lk_t.a").alias("_lk_ta"), F.col("_lk_t.b").alias("_lk_tb")).distinct()
    counted = once.groupBy("_lk_host", "_lk_a", "_lk_b").agg(F.count(F.lit(1)).alias("pages"))
    texts = docs.select(F.col(host).alias("_lk_site"), F.when(F.col(text).isNotNull(), _hashed(F.col(text))).alias("_lk_t"))
    totals = texts.groupBy("_lk_site").agg((F.count_distinct("_lk_t") + F.count_if(F.col("_lk_t").isNull())).alias("host_pages"))
    often = counted.filter(F.col("pages") >= least_pages)
    joined = often.join(totals, F.col("_lk_host").eqNullSafe(F.col("_lk_site")))
    return joined.filter(F.col("pages") > ratio * F.col("host_pages")).drop("_lk_site")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All rows and columns of docs with the text cleaned, and n_lines and n_dropped (long)."""
    found = written(boilerplate(docs, host, text, ratio, least_pages).select("_lk_host", "_lk_a", "_lk_b"), "boilerplate")
    by_host = found.groupBy("_lk_host").agg(F.collect_list(F.struct(F.col("_lk_a").alias("a"), F.col("_lk_b").alias("b"))).alias("_lk_bad"))
    if found.count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    joined = docs.join(by_host, F.col(host).eqNullSafe(F.col("_lk_host")), "left").drop("_lk_host")
    keep = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col("_lk_bad"), _hashed(x)))
    kept = F.when(F.col("_lk_bad").isNull(), _lines(F.col(text))).otherwise(keep)
    sized = joined.withColumn("_lk_kept", kept)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("long")
    n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size("_lk_kept")).cast("long")
    out = sized.withColumns({"n_lines": n_lines, "n_dropped": n_lines - n_kept})
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join("_lk_kept", "\n"))).drop("_lk_kept", "_lk_bad")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Cleaned texts of all documents; a document's source is its host."""
    out = drop_boilerplate(documents(spark, sf_dir))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
p AS (
  SELECT source, line, count(DISTINCT text) AS pages FROM l
  WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY source, line),
h AS (SELECT source, count(DISTINCT text) + count(*) FILTER (WHERE text IS NULL) AS host_pages FROM documents GROUP BY source),
bad AS (
  SELECT p.source, p.line FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source
  WHERE pages >= {LEAST_PAGES} AND pages > {RATIO} * host_pages),
m AS (
  SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AS dropped
  FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
g AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM m GROUP BY doc_id)
SELECT d.doc_id, d.source,
       CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text,
       coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
