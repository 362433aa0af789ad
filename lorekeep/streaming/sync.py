"""Incremental ingestion: landed files as a stream, checkpointed, idempotent; stateful upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def connector(name: str):
    """Registers a normaliser of landed records under a name."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def bucket(key: str = "doc_id"):
    """The folder of a document in the store: two hex digits of its id's hash."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2)


def run_sync(spark: SparkSession, name: str, landing: str, out: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Reads what landed since the last run, normalises it, appends documents not there yet; unreadable rows go to <out>-quarantine.
    The checkpoint resumes; a new one is a full run. The store lies in 256 folders by a hash of the document's id, and a batch reads
    back only its own documents' folders."""
    raw = spark.readStream.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(landing)

    def store(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        bad = batch.where("_corrupt is not null").select("_corrupt")
        if bad.limit(1).count():
            bad.write.mode("append").json(f"{out}-quarantine")
        fresh = REGISTRY[name](batch.where("_corrupt is null").drop("_corrupt")).dropDuplicates(["doc_id", "content_hash"]).withColumn("bucket", bucket())
        folders = [r[0] for r in fresh.select("bucket").distinct().collect()]  # 256 at most
        try:
            known = batch.sparkSession.read.option("basePath", out).schema("doc_id string, content_hash string, bucket string").parquet(out).where(F.col("bucket").isin(folders))
            fresh = fresh.join(known.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti").select(fresh.columns)
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").partitionBy("bucket").parquet(out)
        batch.unpersist()

    return raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoint_of(base: str, mode: str) -> str:
    """The checkpoint folder of a run: the one that lasts for incremental and resumed runs, a new one for a full run."""
    import uuid

    if mode not in ("full", "incremental", "resume"):
        raise ValueError(f"unknown mode {mode}")
    return f"{base}/{uuid.uuid4().hex}" if mode == "full" else f"{base}/lasting"


def sync_log(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """A row per batch of a run that ended: batch, found, seconds."""
    rows = [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, found long, seconds double")


def running_status(changes: DataFrame, key: str = "commitment_id"):
    """A stream of (key, status, changed_at) -> every real change of a key's status: key, old_status, new_status, changed_at. State
    is one status and time per key; a change that is older than the state is ignored. Runs in append mode."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(who, batches, state: GroupState):
        import pandas as pd

        status, at = state.get if state.exists else (None, -1)
        rows = pd.concat(batches).sort_values("changed_at", kind="stable")
        out = []
        for new, when in zip(rows["status"], rows["changed_at"].astype("int64").tolist()):
            if when >= at:
                if new != status:
                    out.append((who[0], status, new, pd.Timestamp(when)))
                status, at = new, when
        state.update((status, at))
        yield pd.DataFrame(out, columns=[key, "old_status", "new_status", "changed_at"])

    typed = changes.select(F.col(key).cast("string").alias(key), "status", F.col("changed_at").cast("timestamp").alias("changed_at"))
    return typed.groupBy(key).applyInPandasWithState(step, f"{key} string, old_status string, new_status string, changed_at timestamp", "status string, at bigint", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Redelivered events dropped within a watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"))


def success_rate(found: int, stored: int) -> float:
    return 1.0 if not found else stored / found
