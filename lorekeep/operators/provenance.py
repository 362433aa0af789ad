"""How do we know this: records of where memory items come from, and what they add up to.

Records: item_type, item_id, source_type, document_id, source_at, people (array of e-mails), excerpt, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C

FIELDS = ("item_type", "item_id", "source_type", "document_id", "source_at", "people", "excerpt", "confidence")


def recorded(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records with new ones added; every call adds evidence, excerpts are cut."""
    new = fresh.select(*FIELDS).withColumn("excerpt", F.substring("excerpt", 1, C.EXCERPT_MOST))
    return records.select(*FIELDS).unionByName(new)


def from_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records of items (item_type, item_id, chunk_id) from their chunks (chunk_id, source_type, document_id, source_at, author, text)."""
    rows = items.join(chunks, "chunk_id")
    people = F.array_compact(F.array("author"))
    return rows.select("item_type", "item_id", "source_type", "document_id", "source_at", people.alias("people"), F.substring("text", 1, 500).alias("excerpt"), F.lit(1.0).alias("confidence"))


def evidence(records: DataFrame, item_type: str, item_id) -> DataFrame:
    """An item's chain of evidence, the earliest first."""
    return records.where((F.col("item_type") == item_type) & (F.col("item_id") == item_id)).orderBy(F.col("source_at").asc_nulls_last(), "document_id")


def learned_from(records: DataFrame, document_id) -> DataFrame:
    return records.where(F.col("document_id") == document_id).orderBy("item_type", "item_id")


def summary(records: DataFrame, most_people: int = 20) -> DataFrame:
    """Per item: sources counted by type, first and last time, people (sorted, capped), and the sentence that says so. Types are
    counted and people made distinct before they are gathered."""
    key = ["item_type", "item_id"]
    by_type = records.groupBy(*key, "source_type").agg(F.count(F.lit(1)).alias("n"), F.min("source_at").alias("a"), F.max("source_at").alias("z"))
    label = lambda x: F.concat(x["n"].cast("string"), F.lit(" "), F.regexp_replace(x["source_type"], "_", " "), F.when(x["n"] > 1, "s").otherwise(""))
    told = by_type.groupBy(*key).agg(F.sum("n").alias("n_sources"), F.array_sort(F.collect_list(F.struct("source_type", "n"))).alias("_t"), F.min("a").alias("first_at"), F.max("z").alias("last_at"))
    names = records.select(*key, F.explode("people").alias("p")).distinct()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("p"))
    people = names.withColumn("_r", rank).where(F.col("_r") <= most_people).groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("people"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    when = F.when(F.col("first_at").isNull(), "").when(F.col("first_at") == F.col("last_at"), F.concat(F.lit(" ("), day("first_at"), F.lit(")"))).otherwise(F.concat(F.lit(" ("), day("first_at"), F.lit(" to "), day("last_at"), F.lit(")")))
    says = F.concat(F.lit("Based on "), F.array_join(F.transform("_t", label), ", "), when)
    return told.join(people, key, "left").select(*key, "n_sources", "first_at", "last_at", F.coalesce("people", F.array().cast("array<string>")).alias("people"), says.alias("summary"))


def coverage(records: DataFrame) -> DataFrame:
    """item_type, n: how many items have evidence."""
    return records.groupBy("item_type").agg(F.count_distinct("item_id").alias("n"))


def full_citation(source_type: Column, source_date: Column, people: Column, chunk_id: Column, excerpt: Column, location: Column, confidence: Column) -> Column:
    """The audit block of one source, a line per field that is known."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Source     : "), F.upper(source_type)),
        F.concat(F.lit("Date       : "), source_date),
        F.when(F.size(people) > 0, F.concat(F.lit("Participants: "), F.array_join(people, ", "))),
        F.concat(F.lit("Reference  : "), chunk_id),
        F.when(excerpt != "", F.concat(F.lit('Excerpt    : "'), excerpt, F.lit('"'))),
        F.when(location != "", F.concat(F.lit("Location   : "), location)),
        F.concat(F.lit("Confidence : "), F.round(confidence * 100).cast("int").cast("string"), F.lit("%")),
    )
