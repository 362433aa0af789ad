"""Search modes over chunks, weighted rank fusion, ranking, and what follows: context, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .graph import shared_checkpoints


def bm25(docs: DataFrame, query: list[str], k: int, id_col: str, text_col: str, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """id and score of the k best documents that hold a query term, best score 1, ties to the smaller id.

    The query's strings are cut into terms the way documents are; repeated terms count once. Texts are read once: what is left of
    them, a few numbers a document, is checkpointed, and both the corpus statistics (one row) and the scores come from that. Terms are
    counted by plain replacement in texts whose tokens stand between blanks; nothing but the k best is shuffled.
    """
    query = X.query_terms(query)
    if not query:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    shared_checkpoints(docs.sparkSession)
    spaced = docs.select(F.col(id_col), F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+", "  "), F.lit(" ")).alias("_t"))
    often = lambda q: ((F.length("_t") - F.length(F.replace("_t", F.lit(f" {q} "), F.lit("")))) / (len(q) + 2)).cast("int")
    toks = spaced.select(id_col, F.regexp_count("_t", F.lit("(?<= )[a-z0-9]++(?= )")).alias("_len"), *[often(q).alias(f"_f{i}") for i, q in enumerate(query)]).checkpoint()
    stats = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg_len"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(query))])
    n = F.col("n")

    def part(i: int) -> Column:
        tf, df = F.col(f"_f{i}"), F.col(f"_d{i}")
        return F.when(tf > 0, F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("avg_len")))).otherwise(0.0)

    raw = toks.where(" or ".join(f"_f{i} > 0" for i in range(len(query)))).join(F.broadcast(stats)).select(id_col, sum((part(i) for i in range(len(query))), F.lit(0.0)).alias("raw"))
    best = raw.orderBy(F.desc("raw"), id_col).limit(k)
    return best.select(id_col, (F.col("raw") / F.max("raw").over(Window.partitionBy(F.lit(1)))).alias("score"))


def top(rows: DataFrame, k: int, id_col: str, score: str = "score") -> DataFrame:
    """The k best, ties to the smaller id."""
    return rows.orderBy(F.desc(score), id_col).limit(k)


def vector_search(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
    """Cosine against a query vector; the payload filter comes before scoring."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, X.cosine(F.col(vector_col), q).alias("score")).where(F.col("score") >= threshold)


def metadata_search(rows: DataFrame, wanted: dict[str, str], id_col: str) -> DataFrame:
    """Share of the wanted keys that match: arrays by element, strings by case-insensitive containment."""
    tests = [F.array_contains(k, v) if rows.schema[k].dataType.typeName() == "array" else F.lower(F.col(k).cast("string")).contains(v.lower()) for k, v in wanted.items()]
    score = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) / len(wanted)
    return rows.select(id_col, score.alias("score")).where("score > 0")


def timeline_search(rows: DataFrame, ts: Column, as_of: Column, id_col: str, most_days: int | None = None) -> DataFrame:
    age = X.days_between(as_of, ts)
    rows = rows.withColumn("_age", age)
    if most_days is not None:
        rows = rows.where(F.col("_age") <= most_days)
    return rows.select(id_col, X.recency(F.col("_age")).alias("score"))


def rank_fusion(hits: DataFrame, id_col: str, weights: dict[str, float] = C.MODE_WEIGHTS, k: int = C.RRF_K) -> DataFrame:
    """hits: mode, id, score, the few best of each mode. Weighted reciprocal ranks w / (k + rank), summed, best 1."""
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("score"), id_col)))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("mode")]
    fused = ranked.groupBy(id_col).agg(F.sum(weight / (k + F.col("_r"))).alias("raw"), F.count(F.lit(1)).alias("n_modes"))
    return fused.select(id_col, (F.col("raw") / F.max("raw").over(Window.partitionBy(F.lit(1)))).alias("score"), "n_modes")


def rank(rows: DataFrame, profile: str = "executive") -> DataFrame:
    """rows: relevance, age_days, source_type, text, relationship. Adds the five factors' weighted sum."""
    return rows.withColumn("final", sum((a * f for a, f in zip(C.RANKING_PROFILES[profile], factors())), F.lit(0.0)))


def factors() -> list[Column]:
    """The five factors that a ranking weighs."""
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("relevance"))), X.freshness(F.col("age_days")), X.authority(F.col("source_type")), X.importance(F.col("text")), F.coalesce(F.col("relationship"), F.lit(0.5))]


def section_top(rows: DataFrame, section: str, n: int, score: str, id_col: str) -> DataFrame:
    """The n best of each section."""
    w = Window.partitionBy(section).orderBy(F.desc(score), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fit_budget(rows: DataFrame, group: str, order: str, text_col: str, budget: int, share: Column | None = None) -> DataFrame:
    """Goes through a group's rows in order: a row that, cut to its share, no longer fits into what is left is excluded and takes
    nothing; one that fits whole is included, a longer one summarised to its share. Groups are the few best rows of a context
    (section_top before); only their token counts are gathered."""
    need = rows.withColumn("tokens", X.token_estimate(F.col(text_col))).withColumn("_share", (F.lit(budget) if share is None else share).cast("long"))
    row = F.struct(F.col(order).alias("o"), F.col("tokens").alias("t"), F.least("tokens", "_share").alias("least"))
    listed = need.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def step(acc, x):
        fits = acc["used"] + x["least"] <= budget
        taken = F.when(fits, x["least"]).otherwise(F.lit(0).cast("long"))
        how = F.when(~fits, "exclude").when(x["t"] <= x["least"], "include").otherwise("summarise")
        return F.struct((acc["used"] + taken).alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].alias(order), how.alias("decision"), taken.alias("final_tokens")))).alias("out"))

    kind = rows.schema[order].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as array<struct<{order}: {kind}, decision: string, final_tokens: bigint>>)").alias("out"))
    decided = listed.select(group, F.explode(F.aggregate("_rows", start, step)["out"]).alias("_d")).select(group, "_d.*")
    return need.drop("_share").join(decided, [group, order])


def attribute(statements: DataFrame, chunks: DataFrame, n: int = 3, least_shared: int = 1, most_words: int = 100_000) -> DataFrame:
    """statement_id, text against chunk_id, text: the n chunks that share most words of four letters or more.

    Up to most_words distinct words of the statements go to all tasks, so that only the chunks' words that some statement holds
    are exploded and shuffled; beyond that the words are joined without this filter."""
    a = statements.select("statement_id", F.explode(X.long_words(F.col("text"))).alias("w"))
    words = X.long_words(F.col("text"))
    wanted = a.select("w").distinct()
    if wanted.limit(most_words + 1).count() <= most_words:
        wanted = F.broadcast(wanted)
        b = chunks.select("chunk_id", F.explode(words).alias("w")).join(wanted, "w", "left_semi")
    else:
        b = chunks.select("chunk_id", F.explode(words).alias("w"))
    shared = a.join(b, "w").groupBy("statement_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
    w = Window.partitionBy("statement_id").orderBy(F.desc("shared"), "chunk_id")
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def conflicts(rows: DataFrame, group: str, text_col: str, pairs=C.CONFLICTS) -> DataFrame:
    """Groups in which one text says one thing and another the opposite."""
    text = F.lower(F.col(text_col))
    tests = [F.max(text.rlike(a)) & F.max(text.rlike(b)) for a, b in pairs]
    found = [F.when(t, F.lit(i)) for i, t in enumerate(tests)]
    return rows.groupBy(group).agg(F.array_compact(F.array(*found)).alias("conflicts")).where(F.size("conflicts") > 0)
