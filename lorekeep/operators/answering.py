"""From a question to an attributable context: plan, five search modes, ranking, sections, budget, citations.

Results of a question are its few best chunks, bounded by the plan, so whatever is gathered per question here is small; the
searches before that are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .graph import reach
from .retrieval import bm25, factors, metadata_search, rank, rank_fusion, timeline_search, top, vector_search


def plan_table(spark: SparkSession, plans: dict = C.PLANS) -> DataFrame:
    """The plans as rows: category, strategy, modes, total, hints, source_type, priority, source_rank, n, recency_weight, filters."""
    rows = [
        (category, strategy, modes, total, hints, source, priority, C.SOURCE_PRIORITIES.index(priority) * 100 + i, n, weight, filters)
        for category, (strategy, modes, total, hints, sources) in plans.items()
        for i, (source, priority, n, weight, filters) in enumerate(sources)
    ]
    schema = "category string, strategy string, modes array<string>, total int, hints array<string>, source_type string, priority string, _at int, n int, recency_weight double, filters map<string,string>"
    return spark.createDataFrame(rows, schema)


def plan(questions: DataFrame) -> DataFrame:
    """Classified questions (question_id, category, temporal, entities) -> a row per source in order of priority: how many results,
    what weight recency has, and the filters, with the question's first entity filled in (filters on it go where there is none)."""
    specs = F.broadcast(plan_table(questions.sparkSession))
    known = F.when(F.col("category").isin(*C.PLANS), F.col("category")).otherwise("general")
    rows = questions.withColumn("category", known).join(specs, "category")
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in C.TEMPORAL_FACTORS.items() for x in kv])[F.col("temporal")], F.lit(1.0))
    entity = F.coalesce(F.element_at("entities", 1) if "entities" in questions.columns else F.lit(None).cast("string"), F.lit(""))
    plain = F.transform_values("filters", lambda _, v: F.when(v == "{}", entity).otherwise(v))
    needs = F.col("category").isin("risk", "commitment")
    rows = rows.withColumns({
        "source_rank": F.row_number().over(Window.partitionBy("question_id").orderBy("_at")),
        "max_results": F.least(F.floor(F.col("n") * factor), F.lit(C.PLAN_CAP)).cast("int"),
        "recency_weight": F.when(F.col("temporal") == "recent", F.least(F.lit(1.0), F.round(F.col("recency_weight") + C.RECENT_BOOST, 6))).otherwise(F.col("recency_weight")),
        "filters": F.when(needs, F.map_filter(plain, lambda _, v: v != "")).otherwise(plain),
    })
    return rows.select("question_id", "category", "strategy", "modes", "total", "hints", "source_type", "priority", "source_rank", "max_results", "recency_weight", "filters")


def relationship_search(links: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, score of what the seeds lead to in fewer than depth steps along links (source, target), 1 / (2 + steps): the seeds
    themselves are the first of the depth's rounds."""
    return reach(links, seeds, depth - 1, both_ways=False).where("hop > 0").select(F.col("node").alias("id"), (1.0 / (2 + F.col("hop"))).alias("score"))


def hybrid(chunks: DataFrame, terms: list[str], vector: list[float] | None, wanted: dict[str, str], seeds: DataFrame | None, links: DataFrame | None, as_of: Column | None, k: int, modes: list[str], id_col: str = "chunk_id") -> DataFrame:
    """All of a plan's modes over chunks (id, text, vector, ts and the wanted columns), k best each, fused by weighted ranks."""
    found = []
    if "semantic" in modes and vector is not None:
        found.append(top(vector_search(chunks.where("vector is not null"), vector, id_col, "vector"), k, id_col).withColumn("mode", F.lit("semantic")))
    if "keyword" in modes and terms:
        found.append(bm25(chunks, terms, k, id_col, "text").withColumn("mode", F.lit("keyword")))
    if "metadata" in modes and wanted:
        found.append(top(metadata_search(chunks, wanted, id_col), k, id_col).withColumn("mode", F.lit("metadata")))
    if "relationship" in modes and seeds is not None:
        near = relationship_search(links, seeds).withColumnRenamed("id", id_col).join(chunks.select(id_col), id_col, "left_semi")
        found.append(top(near, k, id_col).withColumn("mode", F.lit("relationship")))
    if "timeline" in modes and as_of is not None:
        found.append(top(timeline_search(chunks, F.col("ts"), as_of, id_col), k, id_col).withColumn("mode", F.lit("timeline")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return rank_fusion(hits, id_col)


def ranked(rows: DataFrame, category: str, focus: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """rank() by the profile of a question's class, ties measured against the entities in focus; final to four digits."""
    tied = rows.withColumn("relationship", X.tie(F.col("relationships"), F.col("about"), focus))
    return rank(tied, C.PROFILE_OF.get(category, "executive")).withColumn("final", F.round("final", 4)).where(F.col("final") >= least)


def ranked_by(rows: DataFrame, id_col: str, categories: list[str], focus: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """category, id, final: ranked() for several classes at once; the factors, which read the text, are computed once a row."""
    tied = rows.withColumn("relationship", X.tie(F.col("relationships"), F.col("about"), focus))
    profiles = [F.struct(F.lit(c).alias("category"), F.array(*[F.lit(float(w)) for w in C.RANKING_PROFILES[C.PROFILE_OF.get(c, "executive")]]).alias("weights")) for c in categories]
    told = tied.select(id_col, F.array(*[f.cast("double") for f in factors()]).alias("_f"))
    each = told.select(id_col, "_f", F.explode(F.array(*profiles)).alias("_p"))  # beside the factors it would compute them for each class
    final = F.aggregate(F.zip_with("_p.weights", "_f", lambda a, f: a * f), F.lit(0.0), lambda s, x: s + x)
    return each.select(F.col("_p.category").alias("category"), id_col, F.round(final, 4).alias("final")).where(F.col("final") >= least)


def section_table(spark: SparkSession, sections: dict = C.SECTIONS) -> DataFrame:
    rows = [
        (strategy, i, title, a, list(types), n, most, order, mark, dated, typed, test)
        for strategy, parts in sections.items()
        for i, (title, alternatives, n, most, order, mark, dated, typed, test) in enumerate(parts)
        for a, types in enumerate(alternatives)
    ]
    return spark.createDataFrame(rows, "strategy string, section int, title string, alternative int, types array<string>, lines int, most int, ordered string, mark string, dated boolean, typed boolean, test string")


def assemble(results: DataFrame) -> DataFrame:
    """Results (question_id, strategy, chunk_id, source_type, text, ts, score, tags, kind) -> question_id, strategy, section, title,
    content, source_ids: the sections of each question's strategy that have any line, in order."""
    spark = results.sparkSession
    known = F.when(F.col("strategy").isin(*C.SECTIONS), F.col("strategy")).otherwise("general_summary")
    by = Window.partitionBy("question_id")
    rows = results.withColumn("strategy", known).withColumn("_pos", F.row_number().over(by.orderBy(F.desc("score"), "chunk_id")))
    rows = rows.join(F.broadcast(section_table(spark)), "strategy").where((F.size("types") == 0) | F.array_contains("types", F.col("source_type")))
    by = Window.partitionBy("question_id", "section")
    rows = rows.withColumn("_first", F.min("alternative").over(by)).where("alternative = _first")
    fits = F.when(F.col("test") == "escalat", F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t == "escalat")).when(F.col("test") == "deadline", F.coalesce(F.col("kind").contains("deadline"), F.lit(False))).otherwise(True)
    at = F.coalesce(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0))
    order = F.when(F.col("ordered") == "newest", -at).when(F.col("ordered") == "oldest", at).otherwise(F.col("_pos").cast("long"))
    kinds = {t: i for i, t in enumerate(C._TALK)}
    tie = F.when(F.col("ordered") == "newest", F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("source_type")], F.lit(0)) * 1000 + F.col("_pos")).otherwise(F.col("_pos"))
    rows = rows.where(fits).withColumn("_line", F.row_number().over(by.orderBy(order, tie))).where("_line <= lines")
    date = F.when(F.col("dated"), F.concat(F.lit("["), X.date_label(F.col("ts")), F.lit("] "))).otherwise("")
    kind = F.when(F.col("typed"), F.concat(F.upper("source_type"), F.lit(": "))).otherwise("")
    line = F.concat("mark", date, kind, X.snippet(F.col("text"), F.col("most")))
    lines = rows.groupBy("question_id", "strategy", "section", "title").agg(F.array_sort(F.collect_list(F.struct("_line", line.alias("line"), "chunk_id"))).alias("_l"))
    return lines.select("question_id", "strategy", "section", "title", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content"), F.transform("_l", lambda x: x["chunk_id"]).alias("source_ids"))


def adaptive_budget(n_sections: Column, model: int = C.MODEL_TOKENS, system: int = C.SYSTEM_TOKENS) -> Column:
    """Tokens for a context: what the model's window leaves beside prompt and answer, less where there are few sections."""
    room = max(model - system - C.ANSWER_RESERVE, C.LEAST_CONTEXT)
    return F.greatest(F.lit(C.LEAST_CONTEXT), F.least(F.lit(room), n_sections * C.TOKENS_A_SECTION)).cast("long")


def fit_context(sections: DataFrame, budget: Column, header_tokens: Column | None = None) -> DataFrame:
    """Sections (question_id, section, title, content) -> adds priority, tokens, share, decision (include_full, include_summary,
    exclude), final_tokens, final_content. Shares go by priority, 100 tokens at least; sections enter by priority, and one that no
    longer fits is passed over."""
    names = F.create_map(*[F.lit(x) for kv in C.SECTION_PRIORITY.items() for x in kv])
    rows = sections.withColumn("priority", F.coalesce(names[F.lower("title")], F.lit(C.SECTION_LAST))).withColumn("tokens", X.token_estimate(F.col("content"))).withColumn("_budget", budget.cast("long"))
    rows = rows.withColumn("_header", (F.lit(0) if header_tokens is None else header_tokens).cast("long"))
    by = Window.partitionBy("question_id")
    rows = rows.withColumn("_w", F.max("priority").over(by) + 1 - F.col("priority")).withColumn("_want", F.greatest(F.floor(F.col("_budget") * F.col("_w") / F.sum("_w").over(by)), F.lit(C.SECTION_LEAST_TOKENS)))
    item = F.struct("priority", "section", "tokens", F.col("_want").cast("long").alias("want"), "content")
    listed = rows.groupBy("question_id").agg(F.max("_budget").alias("_b"), F.max("_header").alias("_h"), F.array_sort(F.collect_list(item)).alias("_l"))

    def share(acc, x):
        got = F.least(x["want"], acc["left"], F.lit(C.SECTION_MOST_TOKENS).cast("long"))
        return F.struct((acc["left"] - got).alias("left"), F.concat(acc["out"], F.array(got)).alias("out"))

    shares = F.aggregate("_l", F.struct(F.col("_b").alias("left"), F.array().cast("array<bigint>").alias("out")), share)["out"]
    both = F.zip_with("_l", shares, lambda x, s: F.struct(x["section"].alias("section"), x["tokens"].alias("tokens"), s.alias("share"), x["content"].alias("content")))
    kind = "struct<section:int,share:bigint,decision:string,final_tokens:bigint,final_content:string>"

    def step(acc, x):
        fits = acc["used"] + F.least(x["tokens"], x["share"]) <= acc["budget"]
        text = F.when(~fits, "").when(x["tokens"] <= x["share"], x["content"]).otherwise(X.summarised(x["content"], x["share"]))
        how = F.when(~fits, "exclude").when(x["tokens"] <= x["share"], "include_full").otherwise("include_summary")
        taken = X.token_estimate(text).cast("long")
        one = F.struct(x["section"].alias("section"), x["share"].alias("share"), how.alias("decision"), taken.alias("final_tokens"), text.alias("final_content"))
        return F.struct((acc["used"] + taken).alias("used"), acc["budget"].alias("budget"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.col("_h").alias("used"), F.col("_b").alias("budget"), F.array().cast(f"array<{kind}>").alias("out"))
    decided = listed.withColumn("_both", both).select("question_id", F.explode(F.aggregate("_both", start, step)["out"]).alias("d")).select("question_id", "d.*")
    return rows.drop("_budget", "_header", "_w", "_want").join(decided, ["question_id", "section"])


def citations(results: DataFrame) -> DataFrame:
    """Results (question_id, chunk_id, source_type, text, ts, score, people) -> the attribution pool: one record per chunk."""
    best = Window.partitionBy("question_id", "chunk_id").orderBy(F.desc("score"))
    rows = results.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    excerpt = F.concat(F.rtrim(F.substring("text", 1, 150)), F.when(F.length("text") > 150, "\u2026").otherwise(""))
    people = X.participants(F.col("text"), F.col("people"))
    rows = rows.select("question_id", "chunk_id", "source_type", F.substring(F.md5(F.col("chunk_id").cast("string")), 1, 12).alias("attribution_id"), X.date_label(F.col("ts"), "Unknown date").alias("source_date"), people.alias("participants"), excerpt.alias("excerpt"), F.col("score").alias("confidence"))
    parts = F.concat_ws(" \u00b7 ", F.initcap("source_type"), "source_date", F.when(F.size("participants") > 0, F.array_join(F.slice("participants", 1, 2), ", ")))
    return rows.withColumn("inline", F.concat(F.lit("["), parts, F.lit("]")))


def cite(answers: DataFrame, pool: DataFrame, n: int = 3) -> DataFrame:
    """Answers (question_id, answer) against their pools: a row per statement with its n best records by shared words, uncertain
    where there is none, and the answer's coverage."""
    statements = answers.select("question_id", F.posexplode(X.sentences(F.trim("answer"))).alias("pos", "statement")).withColumn("statement", F.trim("statement")).where(F.length("statement") > 10)
    statements = statements.withColumn("_s", F.array_distinct(X.tokens(F.col("statement"))))
    shared = F.size(F.array_intersect("_s", F.array_distinct(X.tokens(F.col("excerpt")))))
    found = statements.join(pool, "question_id").withColumn("shared", shared).where("shared > 0")
    place = F.row_number().over(Window.partitionBy("question_id", "pos").orderBy(F.desc("shared"), F.desc("confidence"), "chunk_id"))
    best = found.withColumn("_r", place).where(F.col("_r") <= n).groupBy("question_id", "pos").agg(F.array_sort(F.collect_list(F.struct("_r", "chunk_id", "inline"))).alias("_l"))
    out = statements.drop("_s").join(best, ["question_id", "pos"], "left")
    ids = F.coalesce(F.transform("_l", lambda x: x["chunk_id"]), F.array().cast("array<string>"))
    out = out.select("question_id", "pos", "statement", ids.alias("cited"), F.concat_ws(" ", "statement", F.array_join(F.transform("_l", lambda x: x["inline"]), " ")).alias("readable"), F.col("_l").isNull().alias("uncertain"))
    return out.withColumn("coverage", F.avg((~F.col("uncertain")).cast("double")).over(Window.partitionBy("question_id")))
