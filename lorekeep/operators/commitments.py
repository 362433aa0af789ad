"""The life of commitments: found in sentences, chased, resolved, overdue. Every operator takes an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .setjoin import most_similar
from .extraction import explode_sentences

_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _on_or_after(as_of: Column, day: Column) -> Column:
    """The next date, as_of included, that falls on the named weekday."""
    out = F.lit(None).cast("date")
    for name in _DAYS:
        out = F.when(day == name, F.next_day(F.date_sub(as_of, 1), name[:3])).otherwise(out)
    return out


def deadline(text: Column, as_of: Column) -> Column:
    """The date of the first spoken deadline that can be read, by the order of C.DEADLINES; null if there is none.

    Weekdays are the next such day, today included; this week ends on Friday; this month and quarter on their last day;
    numbers of hours are rounded up to days; d/d/y is month/day/year, and a day above 12 comes first."""
    t, now = F.lower(text), as_of.cast("date")
    get = lambda i, group: F.regexp_extract(t, C.DEADLINES[i], group)
    friday = F.date_add(now, 4 - F.weekday(now))
    period = lambda unit, ahead: F.when(unit == "day", now).when(unit == "week", F.date_add(friday, 7 * ahead)).when(unit == "month", F.last_day(F.add_months(now, ahead))).when(unit == "quarter", F.last_day(F.add_months(F.trunc(now, "quarter"), 2)))
    parts = F.split(F.regexp_replace(get(2, 2), "-", "/"), "/")
    a, b, y = (parts[k].try_cast("int") for k in range(3))
    year = F.when(y < 100, y + 2000).otherwise(y)
    iso = lambda m, d: F.format_string("%04d-%02d-%02d", year, m, d).try_cast("date")
    written = F.when(get(2, 2) != "", F.when(a > 12, iso(b, a)).otherwise(iso(a, b)))
    which, unit = get(3, 1), get(3, 2)
    named = F.when(unit == "week", F.when(which == "next", F.date_add(now, 7)).otherwise(friday)).when(unit == "month", period(F.lit("month"), F.when(which == "next", 1).otherwise(0))).otherwise(_on_or_after(now, unit))
    n, span = get(4, 2).try_cast("int"), get(4, 3)
    later = F.date_add(now, F.when(span.startswith("week"), 7 * n).when(span.startswith("hour"), F.ceil(n / 24).cast("int")).otherwise(n))
    near = F.when(get(5, 1) == "tomorrow", F.date_add(now, 1)).when(get(5, 1) == "today", now)
    return F.coalesce(_on_or_after(now, get(0, 1)), period(get(1, 2), F.lit(0)), written, named, F.when(span != "", later), near, _on_or_after(now, get(6, 1)))


def detect(sentences: DataFrame, as_of: Column, text_col: str = "sentence", banks: dict[str, list[str]] = C.COMMITMENT_PATTERNS, least: float = 0.2) -> DataFrame:
    """Adds commitment_type (most patterns, first among equals), deadline, owner and confidence; only candidates (future or action
    words) of confidence `least`. Confidence: 0.2 a pattern of that type up to 0.5, future 0.15, action 0.15, deadline 0.1, owner 0.1."""
    t = F.lower(F.col(text_col))
    counts = {name: X.hits(t, patterns) for name, patterns in banks.items()}
    n = F.greatest(*counts.values())
    future, action = t.rlike(C.FUTURE), t.rlike(C.ACTION)
    out = sentences.withColumns({"commitment_type": X.most_hits(t, banks), "n_patterns": n, "deadline": deadline(F.col(text_col), as_of), "owner": F.when(t.rlike(C.OWN), "sender")})
    tenth = lambda has, w: F.when(has, w).otherwise(0.0)
    score = F.least(n * 0.2, F.lit(0.5)) + tenth(future, 0.15) + tenth(action, 0.15) + tenth(F.col("deadline").isNotNull(), 0.1) + tenth(F.col("owner").isNotNull(), 0.1)
    out = out.withColumn("confidence", F.round(F.least(F.lit(1.0), score), 6))
    return out.where((future | action) & (F.col("n_patterns") > 0) & (F.col("confidence") >= least))


def extract(docs: DataFrame, as_of: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New commitments of texts: id (of document and sentence), type, status open, deadline, owner, confidence, normalised text."""
    found = detect(explode_sentences(docs, id_col, text_col), as_of)
    key = F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.col("pos").cast("string")), 256), 1, 32)
    return found.select(key.alias("commitment_id"), id_col, "pos", "commitment_type", F.lit("open").alias("status"), "deadline", "owner", "confidence", F.trim("sentence").alias("sentence"))


def history(commitments: DataFrame, as_of: Column) -> DataFrame:
    """The first audit row of each new commitment."""
    return commitments.select("commitment_id", F.lit(None).cast("string").alias("old_status"), F.col("status").alias("new_status"), F.lit("Extracted from document").alias("reason"), as_of.alias("changed_at"))


def signals(text: Column, patterns: list[str], negated: str | None = None) -> Column:
    """What each pattern finds first as whole words, in the patterns' order; finds right after a negation don't count."""
    low = F.lower(text)
    found = [F.nullif(F.regexp_extract(low, rf"\b({p})\b", 1), F.lit("")) for p in patterns]
    if negated:
        found = [F.when(~F.regexp_extract(low, rf"^(.*?)\b{p}\b", 1).rlike(negated), x) for p, x in zip(patterns, found)]
    return F.array_compact(F.array(*found))


def matched(sentences: DataFrame, commitments: DataFrame, sentence_id: str, least: float = C.MATCH_LEAST) -> DataFrame:
    """sentence_id, company, text -> the open commitment whose words are most alike: commitment_id, status, likeness (above least;
    ties to the smaller id). commitments: commitment_id, company, status, text. A sentence with a company matches only that company's.
    Commitments and sentences meet by the prefixes of their words in order of rarity (setjoin), never by a common word alone."""
    a = sentences.select(F.col(sentence_id).alias("id"), F.col("company").alias("_sc"), X.long_words(F.col("text")).alias("items"))
    b = commitments.where(F.col("status").isin("open", "in_progress")).select(F.col("commitment_id").alias("id"), F.col("company").alias("_cc"), "status", X.long_words(F.col("text")).alias("items"))
    own = most_similar(a.where("_sc is not null"), b, 1, least + 1e-9, group=("_sc", "_cc"))
    found = own.unionByName(most_similar(a.where("_sc is null"), b, 1, least + 1e-9)).withColumnsRenamed({"a": sentence_id, "b": "commitment_id"})
    return found.join(b.select(F.col("id").alias("commitment_id"), "status"), "commitment_id").select(sentence_id, "commitment_id", "status", "likeness")


def transitions(sentences: DataFrame, commitments: DataFrame, sentence_id: str) -> DataFrame:
    """The audit rows that follow-up sentences cause: a sign of completion resolves an open or chased commitment, a sign of chasing
    moves an open one to in_progress. Sentences act in the order of their ids, so what comes after a resolution changes nothing."""
    rows = sentences.where(F.length(F.trim("text")) >= 10).withColumns({"resolved": signals(F.col("text"), C.RESOLUTION, C.NEGATED), "stalled": signals(F.col("text"), C.STALL)})
    rows = rows.where((F.size("resolved") > 0) | (F.size("stalled") > 0))
    found = matched(rows, commitments, sentence_id).join(rows.select(sentence_id, "text", "resolved", "stalled"), sentence_id)
    found = found.withColumn("new_status", F.when(F.size("resolved") > 0, "resolved").otherwise("in_progress"))
    first = F.row_number().over(Window.partitionBy("commitment_id", "new_status").orderBy(sentence_id))
    done = F.min(F.when(F.col("new_status") == "resolved", F.col(sentence_id))).over(Window.partitionBy("commitment_id"))
    chased = F.min(F.when(F.col("new_status") == "in_progress", F.col(sentence_id))).over(Window.partitionBy("commitment_id"))
    found = found.withColumns({"_first": first, "_done": done, "_chased": chased}).where("_first = 1")
    found = found.where((F.col("new_status") == "resolved") | ((F.col("status") == "open") & (F.col("_done").isNull() | (F.col(sentence_id) < F.col("_done")))))
    old = F.when((F.col("new_status") == "resolved") & (F.col("_chased") < F.col("_done")), "in_progress").otherwise(F.col("status"))
    word = F.when(F.col("new_status") == "resolved", F.lit("Resolution evidence detected: ")).otherwise(F.lit("Follow-up detected: "))
    reason = F.concat(word, F.array_join(F.when(F.col("new_status") == "resolved", F.col("resolved")).otherwise(F.col("stalled")), ", "))
    return found.select("commitment_id", old.alias("old_status"), "new_status", reason.alias("reason"), F.trim("text").alias("evidence"), sentence_id)


def apply_transitions(commitments: DataFrame, moved: DataFrame) -> DataFrame:
    """Commitments with the status that their transitions leave them in."""
    last = moved.groupBy("commitment_id").agg(F.max(F.struct((F.col("new_status") == "resolved").alias("r"), "new_status"))["new_status"].alias("_new"))
    return commitments.join(last, "commitment_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
