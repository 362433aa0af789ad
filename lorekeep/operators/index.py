"""A full-text index in files: postings by term, updated by batch, searched without reading texts.

Below a folder lie generations, and in each three Parquet tables, partitioned by batch:

* postings: a term with doc_ids and, for each of them, tfs and ns (terms of the document), in folders by a hash of the term and sorted
  by term, so that a query reads its terms' folders and, by the files' statistics, their row groups. A row holds what a few thousand
  documents have of the term: rows are put together where texts lie, so few are shuffled and sorted.
  Folder -1 has rows without a term, in which each document is once; they are the table of documents.
* gone: doc_id of each document that a batch replaces or removes; what earlier batches say of it no longer counts.
* sizes: docs, terms that the batch adds, less those it takes off; their sums are the corpus statistics.

`sizes` is written last and says that a batch is there: one that failed half-way is never read, and the next one, which takes the same
number, overwrites it. Compaction writes what is live as one batch of a new generation and names that last; readers of the old one are
not disturbed. One writer at a time.

Terms are ASCII words, lower-cased, without stop words, plural endings cut (Harman's S stemmer). Which other characters are letters or
digits, so that an ASCII word beside them is none, Python's Unicode tables say for texts and the JVM's for queries; they differ at most
in characters that one of them does not know yet.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X

#: Folders of postings.
FOLDERS = 64
#: Postings of which rows are put together at once.
TOGETHER = 1 << 21
#: Bytes of text that are cut at once, if one text is no longer.
AT_ONCE = 1 << 24
#: Bytes of UTF-8 as a cut sees them: ASCII letters in lower case, blanks for other ASCII signs than digits and "_".
SEEN = bytes(c if c >= 128 or c == 95 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: An ASCII word that no other letter, digit or "_" touches.
ALONE = re.compile(r"(?<!\w)[a-z0-9]++(?!\w)")
#: Words that are in nearly every English text.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]

_SCHEMAS = {
    "postings": "term string, doc_ids array<long>, tfs array<int>, ns array<int>, batch int, folder int",
    "gone": "doc_id long, batch int",
    "sizes": "docs long, terms long, batch int",
}


def stem(token: Column) -> Column:
    """Plural endings cut: -ies to -y (not after a or e), -es to -e (not after a, e or o), -s (not after u or s)."""
    return (
        F.when(token.rlike("[^ae]ies$"), F.regexp_replace(token, "ies$", "y")).when(token.rlike("ies$"), token)
        .when(token.rlike("[^aeo]es$"), F.regexp_replace(token, "s$", "")).when(token.rlike("es$"), token)
        .when(token.rlike("[^us]s$"), F.regexp_replace(token, "s$", "")).otherwise(token)
    )


def terms(text: Column, stop: list[str] = STOP) -> Column:
    """The index terms of a text, in order."""
    return F.transform(F.filter(X.tokens(text), lambda t: ~t.isin(stop)), stem)


def stemmed(token: str) -> str:
    """What stem() makes of a token."""
    if not token.endswith("s"):
        return token
    if token.endswith("ies"):
        return token if token[-4:-3] in ("", "a", "e") else token[:-3] + "y"
    if token.endswith("es"):
        return token if token[-3:-2] in ("", "a", "e", "o") else token[:-1]
    return token if token[-2:-1] in ("", "u", "s") else token[:-1]


def _put_together(terms, codes, columns):
    """A row for each term: `codes` are the terms' places for each posting, `columns` the postings' doc_id, tf and n."""
    import pyarrow as pa

    order = np.argsort(codes, kind="stable")
    ends = pa.array(np.append(0, np.cumsum(np.bincount(codes, minlength=len(terms)))), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(c[order], kind)) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([terms, *lists], ["term", "doc_ids", "tfs", "ns"])


def _together(batches):
    """Batches of postings (term, doc_id, tf, n) -> rows of many each."""
    import pyarrow as pa

    def put(kept):
        whole = pa.Table.from_batches(kept).combine_chunks()
        terms = pa.concat_arrays(whole["term"].chunks).dictionary_encode(null_encoding="encode")
        return _put_together(terms.dictionary, terms.indices.to_numpy(zero_copy_only=False), [whole[c].to_numpy() for c in ("doc_id", "tf", "n")])

    kept, many = [], 0
    for batch in batches:
        kept.append(batch)
        many += batch.num_rows
        if many >= TOGETHER:
            yield put(kept)
            kept, many = [], 0
    if many:
        yield put(kept)


def _between_blanks(texts):
    """Texts -> what stands between blanks once bytes are as SEEN has them, for all texts; how many of these each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    raw = texts.buffers()[2] or b""
    first = np.frombuffer(texts.buffers()[1], np.int32, 1, 4 * texts.offset)[0]
    seen = bytes(memoryview(raw)[first : first + ends[-1]]).translate(SEEN)
    found = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(seen)))
    return found.flatten(), pc.list_value_length(found).to_numpy()


def _postings(ids, texts, place: dict, stop: frozenset):
    """Place of the term, doc_id, tf and n of each posting of some texts, by term; `place` gets the terms that are new to it."""
    tokens, lengths = _between_blanks(texts)
    tokens = tokens.dictionary_encode()
    flat, ends = [], [0]  # the terms of each different token: mostly one, several where words stand between other than ASCII signs
    for token in tokens.dictionary.cast("binary").to_numpy(zero_copy_only=False):
        for word in [token.decode()] if token.isalnum() else ALONE.findall(token.decode(errors="replace").lower()):
            if word not in stop:
                flat.append(place.setdefault(stemmed(word), len(place)))
        ends.append(len(flat))
    flat, ends, which = np.array(flat, np.int64), np.array(ends), tokens.indices.to_numpy()
    times = np.diff(ends)[which]
    doc = np.repeat(np.repeat(np.arange(len(ids)), lengths), times)
    term = flat[np.repeat(ends[which] - (np.cumsum(times) - times), times) + np.arange(len(doc))]
    n = np.bincount(doc, minlength=len(ids))
    pairs = np.sort(term * len(ids) + doc)
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    term, doc = np.divmod(pairs[new], len(ids))
    tf = np.diff(np.append(new, len(pairs)))
    join = lambda x, y, kind: np.concatenate([x, y]).astype(kind)
    none = np.zeros(len(ids))
    return join(none, term, np.int32), join(ids, ids[doc], np.int64), join(none, tf, np.int32), join(n, n[doc], np.int32)


def _counted(stop: list[str]):
    """doc_id and text -> rows of postings; each document has one without a term as well, which stands for it. Texts are cut and
    counted as arrays: Python looks at a token once for some megabytes of text, not in each document."""
    stop = frozenset(stop)

    def parts(batches):
        import pyarrow.compute as pc

        for batch in batches:
            ends, start = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))), 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + AT_ONCE, "right")) - 1)
                yield batch.column(0)[start:end].to_numpy(), batch.column(1)[start:end].cast("string")
                start = end

    def count(batches):
        import pyarrow as pa

        def put():
            codes, *columns = map(np.concatenate, zip(*kept))
            return _put_together(pa.array(place, pa.string()), codes, columns)

        place: dict[str | None, int] = {None: 0}
        kept, many = [], 0
        for ids, texts in parts(batches):
            kept.append(_postings(ids, texts, place, stop))
            many += len(kept[-1][0])
            if many >= TOGETHER:
                yield put()
                place, kept, many = {None: 0}, [], 0
        if many:
            yield put()

    return count


_ROWS = "term string, doc_ids array<long>, tfs array<int>, ns array<int>"


class TextIndex:
    """Documents have long ids; a null text is an empty one."""

    def __init__(self, spark: SparkSession, path: str, stop: list[str] = STOP):
        self.spark, self.path, self.stop = spark, path.rstrip("/"), stop

    def _stored(self, where: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", where).parquet(where)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        return self._stored(f"{self.path}/current", "generation int").agg(F.max("generation")).first()[0] or 0

    def _read(self, name: str, generation: int, upto: int | None = None) -> DataFrame:
        if name == "docs":
            return self._each(self._read("postings", generation, upto).where("folder = -1")).select("doc_id", "n", "batch")
        rows = self._stored(f"{self.path}/{generation}/{name}", _SCHEMAS[name])
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def last(self, generation: int | None = None) -> int:
        """The number of the last whole batch."""
        at = self.generation() if generation is None else generation
        return self._read("sizes", at).agg(F.max("batch")).first()[0] or 0

    def _write(self, name: str, rows: DataFrame, generation: int, batch: int) -> None:
        writer = rows.drop("batch").write.mode("overwrite").option("compression", "zstd")
        if name == "postings":
            for nearly_all_differ in ("term", "doc_ids.list.element"):
                writer = writer.option(f"parquet.enable.dictionary#{nearly_all_differ}", "false")
            writer = writer.partitionBy("folder")
        writer.parquet(f"{self.path}/{generation}/{name}/batch={batch}")

    @staticmethod
    def _each(rows: DataFrame) -> DataFrame:
        """term, doc_id, tf, n, batch: one row for each posting."""
        one = rows.select("term", F.explode(F.arrays_zip("doc_ids", "tfs", "ns")).alias("_p"), "batch")
        return one.select("term", F.col("_p.doc_ids").alias("doc_id"), F.col("_p.tfs").alias("tf"), F.col("_p.ns").alias("n"), "batch")

    @staticmethod
    def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
        """Rows (doc_id, batch) that no later batch takes off."""
        late = gone.groupBy("doc_id").agg(F.max("batch").alias("_off"))
        return rows.join(late, "doc_id", "left").where("_off is null or _off <= batch").drop("_off")

    def _store(self, postings: DataFrame, gone: DataFrame, off: DataFrame, generation: int, batch: int) -> None:
        folder = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
        dealt = postings.select("term", "doc_ids", "tfs", "ns", folder.alias("folder")).repartition("folder", F.pmod(F.xxhash64(F.col("doc_ids")[0]), F.lit(8)))
        self._write("postings", dealt.sortWithinPartitions("folder", "term"), generation, batch)
        self._write("gone", gone, generation, batch)
        added = self._read("docs", generation).where(F.col("batch") == batch)
        size = lambda rows, sign: rows.agg((sign * F.count(F.lit(1))).alias("docs"), (sign * F.coalesce(F.sum("n"), F.lit(0))).alias("terms"))
        self._write("sizes", size(added, 1).unionByName(size(off, -1)).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).coalesce(1), generation, batch)

    def update(self, docs: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Adds or replaces documents (doc_id, text) and removes those of `deleted` (doc_id); returns the batch's number. A batch has a
        document once; rows without an id are left out. Texts are cut where they lie: only postings are shuffled, once."""
        at = self.generation()
        batch = self.last(at) + 1
        none = self.spark.createDataFrame([], "doc_id long, text string")
        docs = (none if docs is None else docs.select("doc_id", "text")).where("doc_id is not null")
        if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("a document is in the batch twice")
        leave = docs.select("doc_id") if deleted is None else docs.select("doc_id").unionByName(deleted.select("doc_id")).distinct()
        off = self._live(self._read("docs", at, batch - 1), self._read("gone", at, batch - 1)).join(leave, "doc_id", "left_semi")
        cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")))
        postings = cut.mapInArrow(_counted(self.stop), _ROWS)
        self._store(postings, off.select("doc_id"), off, at, batch)
        return batch

    def compact(self) -> int:
        """Writes what is live as the only batch of a new generation; returns its number."""
        at = self.generation()
        last, fresh = self.last(at), at + 1
        gone = self._read("gone", at, last)
        live = self._live(self._each(self._read("postings", at, last)), gone).select("term", "doc_id", "tf", "n")
        postings = live.mapInArrow(_together, _ROWS)
        nothing = live.where("false")
        self._store(postings, nothing.select("doc_id"), nothing, fresh, 1)
        self.spark.range(1).select(F.lit(fresh).alias("generation")).coalesce(1).write.mode("append").parquet(f"{self.path}/current")
        return fresh

    def query_terms(self, query: list[str]) -> list[str]:
        """The distinct terms of a query's strings; cut in Spark, as texts are."""
        row = self.spark.range(1).select(F.array_sort(F.array_distinct(terms(F.lit(" ".join(query)), self.stop))).alias("t"))
        return row.first()[0]

    def postings(self, wanted: list[str]) -> DataFrame:
        """term, doc_id, tf, n of the live documents that hold the terms; reads only the terms' folders."""
        at = self.generation()
        last = self.last(at)
        folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")).distinct().collect()] if wanted else []
        found = self._read("postings", at, last).where(F.col("folder").isin(folders) & F.col("term").isin(wanted))
        return self._live(self._each(found), self._read("gone", at, last)).select("term", "doc_id", "tf", "n")

    def bm25(self, query: list[str], k: int, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
        """doc_id and score of the k best, best score 1, ties to the smaller id."""
        at = self.generation()
        size = self._read("sizes", at, self.last(at)).agg(F.sum("docs").alias("_docs"), (F.sum("terms") / F.sum("docs")).alias("_avg"))
        found = self.postings(self.query_terms(query))
        often = found.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))  # a row for each term of the query
        part = F.log((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("_avg")))
        raw = found.join(F.broadcast(often), "term").join(F.broadcast(size)).groupBy("doc_id").agg(F.sum(part).alias("raw"))
        best = raw.orderBy(F.desc("raw"), "doc_id").limit(k)
        return best.select("doc_id", (F.col("raw") / F.max("raw").over(Window.partitionBy(F.lit(1)))).alias("score"))

    def all_of(self, query: list[str]) -> DataFrame:
        """doc_id of the documents that hold all terms of the query; none for a query without terms."""
        wanted = self.query_terms(query)
        return self.postings(wanted).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select("doc_id")
