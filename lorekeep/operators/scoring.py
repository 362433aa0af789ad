"""Scores of answers against what was expected of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X


def _level(good: Column, fair: Column) -> Column:
    return F.when(good, "PASS").when(fair, "PARTIAL").otherwise("FAIL")


def _share(wanted: Column, found: Column) -> Column:
    return F.size(found) / F.greatest(F.size(wanted), F.lit(1))


def scorecard(answers: DataFrame) -> DataFrame:
    """Seven criteria as PASS, PARTIAL or FAIL and the worst as overall. answers: answer, topics, sources, expected_sources,
    coverage, evidence, latency_ms, category, intent, expected_category, expected_intent."""
    low = F.lower("answer")
    lower = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(x)))
    topics = _share(F.col("topics"), F.filter("topics", lambda t: F.contains(low, F.lower(t))))
    sources = _share(lower("expected_sources"), F.array_intersect(lower("expected_sources"), lower("sources")))
    cites = F.regexp_count(F.col("answer"), F.lit(r"\[.+?\]"))
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    cat, intent = F.col("category") == F.col("expected_category"), F.col("intent") == F.col("expected_intent")
    levels = {
        "classification": _level(cat & intent, cat | intent),
        "accuracy": _level(topics >= 0.8, topics >= 0.5),
        "completeness": _level(sources >= 0.8, sources >= 0.5),
        "citations": _level((F.col("coverage") >= 0.8) & (cites >= 2), F.col("coverage") >= 0.4),
        "missing_context": F.when(F.col("evidence") == 0, "FAIL").when(words < C.LEAST_ANSWER_WORDS, "PARTIAL").otherwise("PASS"),
        "hallucination": F.when(X.words_found(low, C.SPECULATION) > 0, "FAIL").otherwise("PASS"),
        "latency": _level(F.col("latency_ms") <= 0.75 * C.MOST_MS, F.col("latency_ms") <= C.MOST_MS),
    }
    worst = F.least(*[F.array_position(F.array(*map(F.lit, C.SCORE_LEVELS)), c) for c in levels.values()])
    return answers.withColumns(levels | {"overall": F.element_at(F.array(*map(F.lit, C.SCORE_LEVELS)), worst.cast("int"))})


def pass_rates(cards: DataFrame, criteria: list[str]) -> DataFrame:
    """criterion, PASS, PARTIAL, FAIL, pass_rate over all cards."""
    long = cards.select(F.explode(F.create_map(*[x for c in criteria for x in (F.lit(c), F.col(c))])).alias("criterion", "level"))
    out = long.groupBy("criterion").agg(*[F.count_if(F.col("level") == x).alias(x) for x in C.SCORE_LEVELS], F.count(F.lit(1)).alias("_n"))
    return out.withColumn("pass_rate", F.round(F.col("PASS") / F.col("_n"), 6)).drop("_n")


def criteria_met(answers: DataFrame) -> DataFrame:
    """answers: answer, criteria, n_sources -> passed, failed (arrays of criteria) and score: the share met, less for long answers."""
    low = F.lower("answer")
    has = lambda k: X.words_found(low, C.ANSWER_WORDS[k]) > 0
    dated, some = X.any_of(low, C.ANSWER_DATES), F.col("n_sources") > 0
    tests = {
        "dates": dated, "sources": some & has("sources"), "commitments": has("commitments"), "risk_levels": has("risk_levels"), "person_names": F.col("answer").rlike("[A-Z][a-z]+ [A-Z][a-z]+"), "status": has("status"),
        "not_hallucinated": some | has("hedged"), "actionable": has("actionable"), "entities": has("entities") | F.col("answer").rlike("[A-Z][a-z]+"), "deadlines": has("deadlines") & dated,
    }
    met = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    out = answers.withColumn("passed", F.array_intersect("criteria", met)).withColumn("failed", F.array_except("criteria", "passed"))
    score = F.when(F.size("criteria") > 0, F.size("passed") / F.size("criteria")).otherwise(1.0) * F.when(F.length("answer") > C.LONG_ANSWER, C.LONG_FACTOR).otherwise(1.0)
    return out.withColumn("score", F.round(score, 4))


def mean_scores(scored: DataFrame, category: str = "category", score: str = "score") -> DataFrame:
    """Mean score and count per category, and over all (category null)."""
    return scored.rollup(category).agg(F.round(F.avg(score), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def failures(results: DataFrame, required: DataFrame) -> DataFrame:
    """question_id, event, detail: questions (question_id, sources) that got nothing, or nothing from a source they need."""
    got = results.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source_type").alias("have"))
    rows = required.join(got, "question_id", "left")
    empty = rows.where("n is null").select("question_id", F.lit("empty_result").alias("event"), F.lit("").alias("detail"))
    lacks = rows.where("n is not null").select("question_id", F.explode(F.array_except("sources", "have")).alias("detail")).select("question_id", F.lit("missing_source").alias("event"), "detail")
    return empty.unionByName(lacks)


def answer_quality(answer: Column, evidence: Column) -> Column:
    """ungrounded without evidence, uncertain where the answer says so, partial where it speculates or cites nothing, else grounded."""
    low = F.lower(answer)
    flagged = (X.words_found(low, C.SPECULATION[:8]) > 0) | ~answer.rlike(r"\[.+?\]")
    return F.when(evidence == 0, "ungrounded").when(low.contains("insufficient evidence"), "uncertain").when(flagged, "partial").otherwise("grounded")


def stub_answer(context: Column) -> Column:
    """The answer of the engine without a language model: fixed lines for the signs that a context holds."""
    low = F.lower(context)
    parts = [F.when(X.words_found(low, signs) > 0, F.lit(f"{head}\n{line}" if head else line)) for signs, head, line in C.STUB_ANSWER]
    some = reduce(lambda a, b: a | b, (p.isNotNull() for p in parts))
    return F.concat_ws("\n", F.lit(C.STUB_HEAD), *parts, F.when(~some, C.STUB_NOTHING))


def ranked_report(scored: DataFrame, key: str) -> DataFrame:
    """Scored answers as report lines (JSON), the worst first."""
    return scored.orderBy("score", key).select(key, "score", F.to_json(F.struct(*scored.columns)).alias("line"))
