"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Edge cases: a document with a null or blank text fails the base rules and goes; a null doc_id is kept by the near-duplicate stage, as
it names no document to drop; rows that repeat a doc_id are judged, cleaned and packed each, but if any of them is another
document's copy, all with its id go; a null source is a source of its own; an empty table gives an empty result; further columns are
dropped by the first stage. The tables between stages stay below spark.checkpoint.dir, so a run can be looked into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import jaccard, line_dedup, packing, quality
from lorekeep.llm.common import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.judged(docs.select(*COLUMNS), measures=False).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay."""
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    found = jaccard.near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("7 quality rules", quality_rules),
    ("6 line dedup", line_dedup_stage),
    ("3 n-gram Jaccard join", near_duplicate_stage),
    ("1 best-fit packing", packing_stage),
]

#: The tokenizer of the last stage cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
