"""A vector index in files: inverted lists around centroids, searched after the payload filter, with an exact way beside it.

Centroids are fitted by k-means on a bounded sample (`sample` rows of least hash); every row is assigned to its nearest centroid in one
pass and written in a folder per list, so a search reads only the lists it probes. How many lists it probes is fitted as well: the
fewest with which searches among the sample find the wanted share of their true neighbours. Vectors that are null, hold a null or
another number of components, or have no length, are left out; they have no cosine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X

SAMPLE, ITERATIONS = 20_000, 8
#: Of each search's 10 best, the share to be found among the sample, and searches tried.
WANTED, TRIED = 0.97, 200
#: Vectors in a block of rows or queries.
BLOCK = 8192


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(rows: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means: unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), lists, replace=False)]
    for _ in range(ITERATIONS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def probes_for(rows: np.ndarray, centres: np.ndarray, wanted: float = WANTED, k: int = 10) -> int:
    """The fewest lists to probe so that searches among the rows find the wanted share of their k best."""
    asked = rows[:TRIED]
    near = asked @ rows.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2  # not itself
    best = np.argsort(-near, axis=1)[:, : min(k, len(rows) - 1)]
    own = (rows @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list, for each search
    at = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(at[min(len(at) - 1, math.ceil(wanted * len(at)) - 1)]) + 1 if len(at) else 1


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector, made one of doubles, has a length and neither nulls nor NaN."""
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return vectors.where(whole).withColumn(vector_col, F.transform(vector_col, lambda x: x.cast("double"))).where(X.dot(F.col(vector_col), F.col(vector_col)) > 0)


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str, group: str | None = None) -> DataFrame:
    """query_id, id, score, rank: of each query (query_id, query) the k rows of largest cosine, never below 0, ties to the smaller id,
    among the rows of its groups (all rows, if none is named); vectors are usable() and of one size. Blocks of queries meet blocks of rows as matrices, and only what is best
    in a block is shuffled on; scores are summed in the vectors' order, so equal vectors score alike."""
    told = rows.agg(F.count(F.lit(1)), F.count_distinct(F.col(group) if group else F.lit(0))).first()
    many_rows, many = max(1, math.ceil(told[0] / max(1, told[1]) / BLOCK)), max(1, math.ceil(queries.count() / max(1, told[1]) / BLOCK))
    own = F.col(group) if group else F.lit(0)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "query", own.cast("int").alias("_g"), part("query_id", many).alias("_p"), every(many_rows).alias("_r"))
    right = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), own.cast("int").alias("_g"), part(id_col, many_rows).alias("_r"), every(many).alias("_p"))
    kind_q, kind_id = queries.schema["query_id"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()

    def block(asked, there):
        import pyarrow as pa

        flat = lambda c, n: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        found = []
        if asked.num_rows and there.num_rows:
            there = there.sort_by("_id")
            q, r = flat(asked["query"], asked.num_rows), flat(there["_v"], there.num_rows)
            norm = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
            q_norm, r_norm = norm(q), norm(r)
            for start in range(0, len(q), 256):
                near = np.maximum(0.0, (q[start : start + 256] @ r.T) / (q_norm[start : start + 256, None] * r_norm))
                least = np.partition(near, -k, axis=1)[:, -k] if k < len(r) else near.min(axis=1)
                i, j = np.nonzero(near >= least[:, None] - 1e-9)
                score = np.concatenate([np.empty(0), *(
                    np.maximum(0.0, np.cumsum(q[start + i[a : a + 65536]] * r[j[a : a + 65536]], axis=1)[:, -1] / (q_norm[start + i[a : a + 65536]] * r_norm[j[a : a + 65536]]))
                    for a in range(0, len(i), 65536)
                )])
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((start + i[keep], j[keep], score[keep]))
        at, to, score = (np.concatenate([x[c] for x in found]) if found else np.empty(0, np.int64 if c < 2 else float) for c in range(3))
        return pa.table({"query_id": asked["query_id"].take(pa.array(at)), id_col: there["_id"].take(pa.array(to)), "score": pa.array(score)})

    keys = ["_g", "_p", "_r"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, f"query_id {kind_q}, {id_col} {kind_id}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, id_col: str, vector_col: str, lists: int | None = None, sample: int = SAMPLE, wanted: float = WANTED) -> None:
        """vectors: an id, a vector (array of numbers) and any payload columns; `list` is reserved. The sample goes through the driver."""
        rows = usable(vectors, vector_col)
        drawn = [r[0] for r in rows.select(vector_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
        width = max(map(len, drawn), key=[*map(len, drawn)].count) if drawn else 0
        known = _unit(np.array([v for v in drawn if len(v) == width])) if drawn else np.zeros((0, 0))
        centres = fit(known, min(lists or max(1, int(math.sqrt(len(known)))), len(known))) if len(known) else known
        told = [(int(i), [float(x) for x in c]) for i, c in enumerate(centres)]
        probes = probes_for(known, centres, wanted) if len(known) > 1 else 1
        self.spark.createDataFrame(told, "list int, centre array<double>").withColumn("probes", F.lit(probes)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

        rows = rows.where(F.size(vector_col) == width)
        placed = rows.select(F.struct(*rows.columns).alias("_row"), F.col(vector_col).alias("_v"))
        row_kind = placed.schema["_row"].dataType.simpleString()

        def keep(batches):  # the row travels with its list, so nothing is joined
            import pyarrow as pa

            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                own = (flat @ centres.T).argmax(axis=1).astype(np.int32) if len(centres) else np.zeros(batch.num_rows, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], ["_row", "list"])

        placed = placed.mapInArrow(keep, f"_row {row_kind}, list int").select("_row.*", "list")
        placed.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/rows")

    def _centres(self) -> tuple[np.ndarray, int]:
        told = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # as many as there are lists
        return np.array([r["centre"] for r in told]), told[0]["probes"] if told else 1

    def search(self, query: list[float], k: int, id_col: str, vector_col: str, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """id and cosine of the k nearest rows for which `where` holds, ties to the smaller id; `exact` reads all lists."""
        rows = self.spark.read.parquet(f"{self.path}/rows") if len(self._centres()[0]) else None
        if rows is None:
            return self.spark.createDataFrame([], "id long, score double").withColumnRenamed("id", id_col)
        if not exact:
            centres, usual = self._centres()
            order = np.argsort(-(centres @ np.asarray(query, float)), kind="stable")
            rows = rows.where(F.col("list").isin([int(x) for x in order[: min(len(order), probes or usual)]]))
        if where is not None:
            rows = rows.where(where)
        q = F.array(*[F.lit(float(x)) for x in query])
        scored = rows.select(id_col, (X.dot(F.col(vector_col), q) / (F.sqrt(X.dot(F.col(vector_col), F.col(vector_col))) * F.lit(float(np.linalg.norm(query))))).alias("score"))
        return scored.orderBy(F.desc("score"), id_col).limit(k)

    def search_many(self, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
        """queries: query_id, query (array<double>) -> query_id, id, score, rank: each query meets only the lists it probes."""
        centres, probes = self._centres()

        def lists_of(batches):
            import pyarrow as pa

            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                order = np.argsort(-(flat @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = np.repeat(np.arange(batch.num_rows), order.shape[1])
                yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in batch.columns] + [pa.array(order.ravel())], ["query_id", "query", "list"])

        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
        asked = asked.mapInArrow(lists_of, f"query_id {queries.schema['query_id'].dataType.simpleString()}, query array<double>, list int")
        return nearest(asked, self.spark.read.parquet(f"{self.path}/rows"), k, id_col, vector_col, "list")
