"""Tables that change together: versions published by one manifest, change feeds with removals, histories.

A version is a manifest, a small JSON file that names for each table the folders that make it up. Data are written aside first; the
manifest appears by a rename at the end, so a run that fails in between publishes nothing, and a reader sees one version of all tables
whatever is written meanwhile. Two writers cannot both publish the same number: the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last published version; 0 before the first."""
        path, fs = self._at("manifests")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        path, fs = self._at(f"manifests/{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as a version has it; empty where it has none."""
        folders = self.manifest(version).get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def publish(self, added: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None) -> int:
        """Adds rows to some tables and replaces others, all or nothing; returns the version."""
        base = self.version()
        now, written = self.manifest(base), []
        try:
            for fresh, rows in ((False, added or {}), (True, replaced or {})):
                for name, df in rows.items():
                    folder = f"data/{name}-{uuid.uuid4().hex}"
                    written.append(folder)
                    df.write.parquet(f"{self.path}/{folder}")
                    now[name] = ([] if fresh else now.get(name, [])) + [folder]
            self._commit(base + 1, now)
        except BaseException:
            for folder in written:
                path, fs = self._at(folder)
                fs.delete(path, True)
            raise
        return base + 1

    def _commit(self, version: int, manifest: dict[str, list[str]]) -> None:
        aside, fs = self._at(f"manifests/.{uuid.uuid4().hex}")
        final, _ = self._at(f"manifests/{version:010d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise Conflict(f"version {version} is published already")

    def forget(self, keep: int = 1) -> int:
        """Deletes manifests but the last `keep`, and folders that none of these names; returns how many folders went."""
        last = self.version()
        kept = {f for v in range(max(1, last - keep + 1), last + 1) for folders in self.manifest(v).values() for f in folders}
        path, fs = self._at("manifests")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName()[:-5].isdigit() and int(s.getPath().getName()[:-5]) <= last - keep:
                fs.delete(s.getPath(), False)
        path, fs = self._at("data")
        gone = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if f"data/{s.getPath().getName()}" not in kept]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key by `order` (a column of any ordered type), whatever the order of arrival. Among changes of equal
    order a removal wins, then the larger row; counts are combined before the shuffle, so a busy key is no task of its own."""
    rest = [c for c in changes.columns if c not in (key, order, "deleted")]
    row = F.struct(F.col(order), F.col("deleted"), *rest)
    return changes.groupBy(key).agg(F.max(row).alias("_r")).select(key, "_r.*").select(*changes.columns)


class FeedStore:
    """Records kept up to date by a feed of changes (key, order, deleted, payload), and what was derived from them.

    Each batch appends the last change of each of its keys, removals as rows too, so a change that comes late, twice or after a
    removal never wins over a later one. Derived rows carry their record's order and count only while it is the record's last: a
    changed or removed record takes its chunks and vectors with it. Both are published as one version."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None):
        """derived: table -> (its schema, which has key and order; a function from records to its rows)."""
        self.tables, self.schema, self.key, self.order, self.derived = Tables(spark, path), schema, key, order, derived or {}

    def apply(self, changes: DataFrame) -> int:
        spark = self.tables.spark
        wanted = spark.createDataFrame([], self.schema).columns
        fresh = latest(changes.select(*wanted).where(F.col(self.key).isNotNull() & F.col(self.order).isNotNull()).withColumn("deleted", F.coalesce("deleted", F.lit(False))), self.key, self.order)
        live = fresh.where("not deleted")
        return self.tables.publish({"log": fresh, **{name: make(live) for name, (_, make) in self.derived.items()}})

    def _last(self, version: int | None) -> DataFrame:
        return latest(self.tables.read("log", self.schema, version), self.key, self.order)

    def current(self, version: int | None = None) -> DataFrame:
        """Records as they are, or were at a version."""
        return self._last(version).where("not deleted").drop("deleted")

    def rows_of(self, name: str, version: int | None = None) -> DataFrame:
        """Derived rows of the records as they are. A record that came twice with the same order has its rows once."""
        version = self.tables.version() if version is None else version
        stamp = self._last(version).where("not deleted").select(self.key, self.order)
        return self.tables.read(name, self.derived[name][0], version).distinct().join(stamp, [self.key, self.order], "left_semi")

    def compact(self, forget_before: Column | None = None) -> int:
        """One folder per table with the last change of each key and live derived rows. Removals stay, lest older changes that are
        still to come bring a record back; those for which `forget_before` holds go."""
        last = self._last(None)
        if forget_before is not None:
            last = last.where(~(F.col("deleted") & forget_before))
        return self.tables.publish(replaced={"log": last, **{name: self.rows_of(name) for name in self.derived}})

    def folders(self) -> int:
        return sum(map(len, self.tables.manifest().values()))

    def follow(self, changes: DataFrame, checkpoint: str, most_folders: int = 64) -> StreamingQuery:
        """Applies a stream of changes batch by batch. A batch that is run again after a failure changes nothing."""

        def step(batch: DataFrame, epoch: int) -> None:
            self.apply(batch)
            if self.folders() > most_folders:
                self.compact()

        return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(snapshots: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """key, values, valid_from, valid_to (exclusive, null: still valid) from what was seen at times; equal neighbours are one version."""
    over = Window.partitionBy(key).orderBy(at)
    seen = F.struct(*values)
    once = snapshots.groupBy(key, at).agg(F.max(seen).alias("_v"))
    changed = once.withColumn("_p", F.lag("_v").over(over)).where("_p is null or not (_p <=> _v)")
    return changed.select(key, "_v.*", F.col(at).alias("valid_from"), F.lead(at).over(over).alias("valid_to"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, values: list[str], days: int = 7) -> DataFrame:
    """Facts with the values of their key's last version whose `since` is not later than the fact's `at`; null where there is none.

    Both sides are cut into bins of some days. Within a bin facts and versions are merged in order of time; what a bin begins with is
    found from one row per key and bin. So a busy key is spread over its bins, and no fact meets more than its bin's versions."""
    bin_of = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400 * days))
    value = F.struct(*values)
    v = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), bin_of(since).alias("_b"), F.col(since).alias("_t"), value.alias("_v"))
    f = facts.select("*", F.col(key).alias("_k"), bin_of(at).alias("_b"), F.col(at).alias("_t"))
    last = v.groupBy("_k", "_b").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_last"))
    bins = f.select("_k", "_b").where("_k is not null and _b is not null").distinct().join(last, ["_k", "_b"], "full")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opening = bins.select("_k", "_b", F.last("_last", ignorenulls=True).over(before).alias("_open"))
    both = f.withColumn("_v", F.lit(None).cast(v.schema["_v"].dataType)).withColumn("_fact", F.lit(1)).unionByName(v.withColumn("_fact", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("_k", "_b").orderBy("_t", "_fact", "_v").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("_in", F.last("_v", ignorenulls=True).over(upto)).where("_fact = 1")
    found = merged.join(opening, ["_k", "_b"], "left").withColumn("_found", F.coalesce("_in", "_open"))
    return found.select(*facts.columns, *[F.col(f"_found.{c}").alias(c) for c in values])
