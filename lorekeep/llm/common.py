"""Helpers shared by the training-data operators: shared scratch tables, word hashing, text readers."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a local one where that is unset and nothing runs
    elsewhere (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lorekeep-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lorekeep/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Hands freed memory of this Python process back to the system; called before each large group."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs; called after a table has been written."""
    gc.collect()  # plans that only Python's garbage still holds
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8 bytes; bytes.split() cuts at exactly these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """word -> 8 bytes of its 64-bit hash; emptied at a size bound, so memory stays bounded on any vocabulary."""

    BOUND = 250_000

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        out = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        self[word] = out
        return out


def slices_for(total: int, each: int, least: int = 64) -> int:
    """A number of slices so that each gets about `each` units, never under `least`."""
    return max(least, math.ceil(total / max(1, each)))


def sized(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and characters of a table, in one pass that reads one column."""
    n, c = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    return int(n or 0), int(c or 0)


IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
