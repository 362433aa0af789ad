"""Memories that tell of one situation, put together: which chunks belong together, what they say, where they contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .graph import components

KEYS = ("company", "project", "person")


def close_in_time(a: Column, b: Column, days: int = C.FUSE_DAYS) -> Column:
    """Within `days` of each other; an unknown time is close to any."""
    apart = F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp")))
    return F.coalesce(apart <= days * 86400, F.lit(True))


def related(chunks: DataFrame, group: str = "question_id", least: float = C.FUSE_JACCARD, least_shared: int = 1) -> DataFrame:
    """Pairs (group, a, b, shared, likeness) of chunks that tell of one situation: they share a company, project or person (by case-
    insensitive name), and are linked, or alike in words and close in time. Chunks are the few results of a question (group); pairs
    are sought by equal names only."""
    keyed = chunks.select(group, F.col("chunk_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lower(F.col(k)).alias("v")) for k in KEYS])).alias("e")).select(group, "id", "e.*").where("v <> ''")
    a, b = keyed.withColumnRenamed("id", "a"), keyed.withColumnRenamed("id", "b")
    pairs = a.join(b, [group, "k", "v"]).where("a < b").groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
    body = chunks.select(group, "chunk_id", F.array_distinct(X.tokens(F.col("text"))).alias("w"), "ts", F.coalesce("relationships", F.array().cast("array<string>")).alias("rel"))
    side = lambda x: body.select(group, F.col("chunk_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("w", "ts", "rel")])
    both = pairs.join(side("a"), [group, "a"]).join(side("b"), [group, "b"]).withColumn("likeness", X.jaccard(F.col("w_a"), F.col("w_b")))
    linked = F.array_contains("rel_a", F.col("b")) | F.array_contains("rel_b", F.col("a"))
    return both.where(linked | ((F.col("likeness") >= least) & close_in_time(F.col("ts_a"), F.col("ts_b")))).select(group, "a", "b", "shared", "likeness")


def without_repeats(sentences: Column, like: float = C.SAME_SENTENCE) -> Column:
    """Sentences in order, without those that are nearly one that came before."""

    def step(kept, s):
        words = F.array_distinct(X.tokens(s))
        again = F.exists(kept, lambda k: X.jaccard(F.array_distinct(X.tokens(k)), words) > like)
        return F.when(again, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)


def fuse(chunks: DataFrame, group: str = "question_id") -> DataFrame:
    """The report's fused memories: per group of two or more related chunks their ids, topic, text without repeated sentences, tags,
    conflicts (numbers of C.CONFLICTS), confidence, times. Chunks: question_id, chunk_id, text, ts, company, project, person, tags,
    relationships. What belongs to no group is left out (chunks anti-join member ids)."""
    name = lambda x: F.to_json(F.struct(F.col(group).alias("g"), F.col(x).alias("c")))
    pairs = related(chunks, group).select(name("a").alias("a"), name("b").alias("b"))
    of = components(pairs, "a", "b")
    rows = chunks.withColumn("node", name("chunk_id")).join(of, "node")
    parts = F.filter(F.transform(X.sentences(F.trim("text")), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    at = F.coalesce(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0))
    item = F.struct(at.alias("at"), "chunk_id", parts.alias("s"), *[known(k).alias(k) for k in KEYS], F.lower("text").alias("t"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    told = rows.groupBy(group, "component").agg(F.array_sort(F.collect_list(item)).alias("l"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    first = {k: F.element_at(F.concat(F.array_sort(F.array_compact(F.transform("l", lambda x: F.when(x[k].isNotNull(), F.struct(x["chunk_id"].alias("i"), x[k].alias("v")))))), F.array(F.lit(None).cast("struct<i:string,v:string>"))), 1)["v"] for k in KEYS}
    topic = F.coalesce(*[F.concat(F.lit(f"{k.capitalize()}: "), first[k]) for k in ("project", "company", "person")], F.lit("General"))
    said = lambda p: F.exists("l", lambda x: x["t"].rlike(p))
    clash = F.array_compact(F.array(*[F.when(said(p) & said(q), F.lit(i)) for i, (p, q) in enumerate(C.CONFLICTS)]))
    return told.select(
        group, F.array_sort(F.transform("l", lambda x: x["chunk_id"])).alias("chunk_ids"), topic.alias("topic"),
        F.array_join(without_repeats(F.flatten(F.transform("l", lambda x: x["s"]))), " ").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("l", lambda x: x["tags"])))).alias("tags"), clash.alias("conflicts"),
        F.round(1.0 - 0.1 * (F.size(clash) > 0).cast("int"), 2).alias("confidence"), "first_at", "last_at",
    )


def fused_id(chunk_ids: Column) -> Column:
    """A stable id of a fused memory."""
    return F.concat(F.lit("fusion_"), F.substring(F.md5(F.array_join(chunk_ids, "|")), 1, 12))


def date_range(first: Column, last: Column) -> Column:
    day = lambda c: F.date_format(c, "MMM dd, yyyy")
    return F.when(first.isNull(), "unknown date range").when(F.to_date(first) == F.to_date(last), day(first)).otherwise(F.concat(day(first), F.lit(" – "), day(last)))


def in_order(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """The first row of each key, in the order they came."""
    w = Window.partitionBy(group, key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
