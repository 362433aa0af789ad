"""Exact top-k search by Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their id. A block holds its integer vectors and, for
each dimension, its rows in order of that component. A query walks all lists downwards together
(from the top where its own component is positive, from the bottom where it is negative), scores each
row when it is first met, and stops as soon as the sum over dimensions of (component of the query x
value at the list's depth) is below its kth score: no unseen row can reach it. Equal bounds go on,
since a tie may have a smaller id. The k best of every block meet in a final top-k per query.

The queries (every 50th row) meet all blocks: a stated query set against all rows, in blocks. They
travel in query blocks of bounded size, each paired with every candidate block.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part; vectors of
different lengths have no product and never meet; repeated rows (same id and vector) count once; a
query's own id is never its candidate; fewer candidates than k give fewer rows; an empty table gives
an empty result; other columns are ignored. Products beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices_for, written

SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 1024


def _exact_dtype(q: np.ndarray, v: np.ndarray) -> bool:
    """True if products of the two fit exactly into doubles."""
    if not len(q) or not len(v) or not q.shape[1]:
        return True
    return float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**52


class Lists:
    """A block of candidates with its sorted per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], np.ascontiguousarray(vectors[order])
        self.by = np.argsort(self.v, axis=0, kind="stable")  # ascending, column by column
        self.sorted = np.take_along_axis(self.v, self.by, axis=0)

    def top(self, query_id: int, q: np.ndarray, k: int, first: int = 32) -> list[tuple[int, int]]:
        """The k best (score, id): larger scores first, then smaller ids."""
        n, dims = self.v.shape
        seen = np.zeros(n, dtype=bool)
        best_s, best_i = np.zeros(0, self.v.dtype), np.zeros(0, np.int64)
        up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
        depth, step = 0, first
        while depth < n:
            to = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            met[self.by[depth:to, up].ravel()] = True
            met[self.by[n - to : n - depth, down].ravel()] = True
            if not len(up) and not len(down):
                met[:] = True
                to = n
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            new = new[self.ids[new] != query_id]
            scores = self.v[new] @ q
            if len(new) > k:
                kth = np.partition(scores, len(new) - k)[len(new) - k]
                keep = scores >= kth
                new, scores = new[keep], scores[keep]
            s, i = np.concatenate([best_s, scores]), np.concatenate([best_i, self.ids[new]])
            order = np.lexsort((i, -s))[:k]
            best_s, best_i = s[order], i[order]
            depth, step = to, step * 2
            if depth < n and len(best_s) == k:
                bound = self.sorted[depth, up] @ q[up] + self.sorted[n - 1 - depth, down] @ q[down]
                if bound < best_s[-1]:
                    break
        return [(int(a), int(b)) for a, b in zip(best_s, best_i)]


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the integer vector; rows that take no part are gone, repeated rows are one."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    ints = F.transform(v, lambda x: F.floor(x * scale))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v")).distinct()


def threshold_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for integer vectors (vec_id, v) and queries of the same form."""
    n, m = vectors.count(), queries.count()
    blocks, sets = slices_for(n, block_rows, 1), slices_for(m, query_rows, 1)
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).alias("set"))
    cells = dealt.select("dims", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))).alias("set"), F.lit(False).alias("asks"), "vec_id", "v")
    asks = asked.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "set", F.lit(True).alias("asks"), F.col("query_id").alias("vec_id"), "v")

    def cell(table):
        import pyarrow as pa

        dims = table.column("dims")[0].as_py()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        all_v = flat.reshape(len(ids), dims)
        out = []
        v, q = all_v[~asks], all_v[asks]
        if len(v) and len(q):
            kind = np.float64 if _exact_dtype(q, v) else object
            lists = Lists(ids[~asks], v.astype(kind))
            for query_id, row in zip(ids[asks].tolist(), q.astype(kind)):
                out += [(query_id, i, s) for s, i in lists.top(query_id, row, k)]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = cells.unionByName(asks).groupBy("dims", "block", "set").applyInArrow(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return threshold_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP10_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
