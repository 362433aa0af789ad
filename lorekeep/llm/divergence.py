"""Source divergence audit by joint count histograms.

How far the sources of a language differ in the words they use, and by which words a source stands
out. A term's share in a group is smoothed and held as an integer, p = 1 + floor(10^9 (count + 2) /
(N + 2 V)), so every sum is exact and independent of how the rows were dealt.

A share depends on the count alone, and counts are few and mostly small. So for each pair of sources
the combinations (count here, count there) are tallied over the kept terms and f is evaluated once per
combination, times its multiplicity; no row is made per pair and term. Terms that neither source has
are the combination (0, 0): its multiplicity is what is left of V.

Three passes: (1) tasks count terms per (lang, source) in their rows and emit each term once per flush,
which Spark adds up; (2) terms in enough documents get a number; (3) the counts are dealt into cells of
(lang, bucket of terms, two blocks of sources), of 4,096 terms on average by 128 sources, and
each cell tallies all its pairs. A language with many sources or terms becomes many cells, whose partial
sums Spark adds; a frequent term is one row per source, however often it occurs.

Edge cases: a null text, lang or source is ''; a group without kept terms has all counts zero; a language
without kept terms gives pairs of value 0 and no terms; repeated rows and ids count as often as they
occur; ties go to the smaller item in UTF-8 order; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, documents, dropped, scratch_path

#: A kept term is in at least so many documents of its language.
LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Terms of a cell, and sources of one of its two blocks.
TERMS, BLOCK = 4_096, 64
#: A task emits its counts when it holds so many.
HELD = 300_000

#: Bytes of a term: letters A-Z (lower-cased), a-z and all beyond ASCII; the others separate.
TERM_BYTES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in LOWER)

_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it)."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                if terms:
                    size = len(terms)
                    arrays = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array((d[t] for t in terms), pa.int64(), size=size)]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    found = text.translate(TERM_BYTES).split()
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(found)
                    d.update(set(found))
                if sum(len(n) for n, _ in held.values()) >= HELD:
                    yield from flush()
        yield from flush()

    told = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*told, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exact for any long count."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(38,0)")
    below = F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", wide, below) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(codes: list[np.ndarray], shares: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """For each pair of sources, f summed over the terms: each source has its terms' codes and the share of each code."""
    out = []
    for i, j in pairs:
        wide = len(shares[j])
        joint = codes[i] * wide + codes[j]
        if len(shares[i]) * wide <= 4 * len(joint) + 1024:
            tally = np.bincount(joint)
            cells = np.flatnonzero(tally)
            times = tally[cells]
        else:
            cells, times = np.unique(joint, return_counts=True)
        p, q = shares[i][cells // wide], shares[j][cells % wide]
        out.append(int(((p - q) ** 2 // (p + q) * times).sum()))
    return out


def _cell(key, table):
    """Partial sums of all pairs of sources of one cell; rows with tid -1 name the sources."""
    import pyarrow as pa

    lang, _, a, b = (k.as_py() for k in key)
    idx, tid, n, total, kept = (table.column(c).to_numpy() for c in ("idx", "tid", "n", "total", "kept"))
    names = tid < 0
    order = np.argsort(idx[names])
    sources, totals = idx[names][order], total[names][order]
    terms, at = np.unique(tid[~names], return_inverse=True)
    counts = np.zeros((len(sources), len(terms)), np.int64)
    counts[np.searchsorted(sources, idx[~names]), at] = n[~names]
    codes, shares = [], []
    for row, whole in zip(counts, totals):
        levels, code = np.unique(row, return_inverse=True)
        below = max(1, int(whole) + 2 * int(kept[0]))
        codes.append(code.astype(np.int64))
        shares.append(np.array([1 + SCALE * (int(c) + 2) // below for c in levels], np.int64))
    block = sources // BLOCK
    pairs = [(i, j) for i in range(len(sources)) for j in range(i + 1, len(sources)) if block[i] == a and block[j] == b]
    sums = pair_sums(codes, shares, pairs) if len(terms) else [0] * len(pairs)
    left, right = (np.array([sources[p[k]] for p in pairs], np.int32) for k in (0, 1))
    columns = [pa.array([lang] * len(pairs), pa.string()), pa.array(left), pa.array(right), pa.array(sums, pa.int64()), pa.array([len(terms)] * len(pairs), pa.int64())]
    return pa.Table.from_arrays(columns, ["lang", "i", "j", "value", "cells"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark, made = docs.sparkSession, []

    def kept_as(df: DataFrame, name: str) -> DataFrame:
        made.append(scratch_path(spark, name))
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    counted = kept_as(term_counts(docs), "terms")
    vocabulary = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    vocabulary = kept_as(vocabulary.select("lang", "term", "all", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    counts = kept_as(counted.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "tid", "n", "all"), "counts")
    dropped(spark, made[0])

    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("whole"))
    of_lang = Window.partitionBy("lang")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "whole")),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("idx"), F.count(F.lit(1)).over(of_lang).alias("sources"),
    )
    groups = kept_as(groups, "groups")

    buckets = F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("int")
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    names = groups.select("*", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), F.lit(-1).cast("long").alias("tid"), F.lit(0).cast("long").alias("n"))
    rows = counts.select("lang", "source", "tid", "n").join(groups, ["lang", "source"]).withColumn("bucket", F.pmod(F.hash("tid"), buckets))
    own, other = F.floor(F.col("idx") / BLOCK).cast("int"), F.col("_other")
    dealt = names.select(*rows.columns).unionByName(rows).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("lang", "bucket", F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), "idx", "tid", "n", "total", "kept")
    sums = dealt.groupBy("lang", "bucket", "a", "b").applyInArrow(_cell, "lang string, i int, j int, value long, cells long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("cells").alias("cells"))

    side = {k: groups.select("lang", F.col("idx").alias(k), F.col("source").alias(f"source_{k}"), share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias(f"p_{k}")) for k in "ij"}
    kept = groups.select("lang", "kept").distinct()
    whole = sums.join(side["i"], ["lang", "i"]).join(side["j"], ["lang", "j"]).join(kept, "lang")
    whole = whole.withColumn("value", F.col("value") + (F.col("kept") - F.col("cells")) * gap(F.col("p_i"), F.col("p_j")))
    both = F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item")))
    of_pairs = whole.select("lang", "value", F.explode(both).alias("_of")).select("lang", "_of.source", "_of.item", "value", F.lit("pair").alias("part"))

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("whole"), F.col("kept"))
    of_terms = counts.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    of_terms = of_terms.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    best = of_terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return of_pairs.withColumn("rank", rank).select(*columns).unionByName(best.select(*columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources by distance, and the terms that mark each source, for all documents."""
    return audit(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS kept, sum(n) AS whole FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.kept)) AS p,
         1 + (({SCALE}::HUGEINT * (v.n + 2)) // (l.whole + 2 * l.kept)) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang)
  LEFT JOIN c USING (lang, source, term)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) s USING (lang, source)),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM f)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
