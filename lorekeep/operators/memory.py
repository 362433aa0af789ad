"""Entities' memory: enrichment from observations, records, links, and the views of persons, companies and projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X


def enriched(entities: DataFrame, observed: DataFrame, key: str, first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """One row per key: what is known stays, gaps are filled by the earliest observation that knows better, keys not yet there are
    created; first sight is the least, last sight the greatest. Both tables have the same columns."""
    both = entities.withColumn("_new", F.lit(0)).unionByName(observed.withColumn("_new", F.lit(1)))
    rest = [c for c in entities.columns if c not in (key, first, last)]
    order = F.struct("_new", F.coalesce(F.unix_micros(F.col(first).cast("timestamp")), F.lit(2**62)))
    fills = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    return both.groupBy(key).agg(*fills, F.min(first).alias(first), F.max(last).alias(last)).select(*entities.columns)


def recorded(records: DataFrame, entity: str, record_id: str, at: str, keep: int = 100) -> DataFrame:
    """entity, ids (the latest `keep`, oldest first), n (all distinct records), last_at: repeated records count once."""
    once = records.groupBy(entity, record_id).agg(F.max(at).alias("_at"))
    totals = once.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("last_at"))
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("_at"), F.desc(record_id)))
    kept = once.withColumn("_r", rank).where(F.col("_r") <= keep).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(record_id).alias("id")))).alias("_l"))
    return totals.join(kept, entity).select(entity, F.transform("_l", lambda x: x["id"]).alias("ids"), "n", "last_at")


def linked_set(links: DataFrame, entity: str, *columns: str) -> DataFrame:
    """entity, links: its distinct links as sorted structs."""
    return links.select(entity, *columns).distinct().groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("links"))


def typed_edges(documents: DataFrame, members: dict[str, str]) -> DataFrame:
    """source_type, source, target_type, target, n: what occurs together in documents. members: type -> array column; persons meet
    companies, projects and each other, companies meet projects; pairs of one type go from the smaller to the larger id."""
    kinds = [("person", "company"), ("person", "project"), ("company", "project"), ("person", "person")]
    parts = []
    for a, b in kinds:
        if a in members and b in members:
            rows = documents.select(F.explode(F.array_distinct(members[a])).alias("source"), F.col(members[b]).alias("_b")).select("source", F.explode(F.array_distinct("_b")).alias("target"))
            parts.append((rows.where("source < target") if a == b else rows).select(F.lit(a).alias("source_type"), "source", F.lit(b).alias("target_type"), "target"))
    return reduce(DataFrame.unionByName, parts).groupBy("source_type", "source", "target_type", "target").agg(F.count(F.lit(1)).alias("n"))


def _tallies(rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(test).alias(name) for name, test in counts.items()])


_LIVE = ("open", "in_progress")


def views(entities: DataFrame, key: str, commitments: DataFrame, risks: DataFrame, interactions: DataFrame, as_of: Column) -> DataFrame:
    """Entities with their tallies: open, overdue and completed commitments, active, critical and high risks, interactions, first and
    last contact and days since. Each side is counted by itself and joined by key, so nothing fans out. commitments: key, status, due;
    risks: key, severity, status; interactions: key, occurred_at."""
    live = F.col("status").isin(*_LIVE)
    c = _tallies(commitments, key, open_commitments=live, overdue_commitments=live & (F.col("due") < as_of), completed_commitments=F.col("status").isin("resolved", "completed"))
    active = F.col("status") != "resolved"
    r = _tallies(risks, key, active_risks=active, critical_risks=active & (F.col("severity") == "critical"), high_risks=active & (F.col("severity") == "high"))
    i = interactions.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("interactions"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    out = entities.join(c, key, "left").join(r, key, "left").join(i, key, "left")
    counted = ["open_commitments", "overdue_commitments", "completed_commitments", "active_risks", "critical_risks", "high_risks", "interactions"]
    return out.fillna(0, counted).withColumn("days_since_contact", X.days_between(as_of, F.col("last_at")))


def project_health(projects: DataFrame, as_of: Column) -> DataFrame:
    """Project views (status, due, health_score and tallies) with days_left, is_overdue and health: critical, at_risk, healthy, stable."""
    left = X.days_between(F.col("due"), as_of)
    rows = projects.withColumn("days_left", left).withColumn("is_overdue", F.coalesce((F.col("days_left") < 0) & ~F.col("status").isin("completed", "cancelled"), F.lit(False)))
    bad = (F.col("critical_risks") > 0) | (F.col("overdue_commitments") > 2) | F.col("is_overdue")
    worse = (F.col("overdue_commitments") > 0) | (F.col("active_risks") > 3)
    return rows.withColumn("health", F.when(bad, "critical").when(worse, "at_risk").when(F.col("health_score") > 0.7, "healthy").otherwise("stable"))


def timeline(events: DataFrame, kind: str, entity_id: str, since: Column | None = None, until: Column | None = None, types: list[str] | None = None, milestones_only: bool = False, n: int = 200) -> DataFrame:
    """An entity's events in order of time, the first n. kind: person, company or project."""
    tests = [F.array_contains(f"{kind}_ids", entity_id)]
    if since is not None:
        tests.append(F.col("occurred_at") >= since)
    if until is not None:
        tests.append(F.col("occurred_at") <= until)
    if types:
        tests.append(F.col("event_type").isin(*types))
    if milestones_only:
        tests.append(F.col("is_milestone"))
    return events.where(reduce(lambda a, b: a & b, tests)).orderBy("occurred_at", "event_id").limit(n)


def cross_timeline(events: DataFrame, entities: dict[str, list[str]], n: int = 500) -> DataFrame:
    """Events of any of several entities, in order of time; no entity, no event."""
    tests = [F.arrays_overlap(f"{kind}_ids", F.array(*map(F.lit, ids))) for kind, ids in entities.items() if ids]
    if not tests:
        return events.limit(0)
    return events.where(reduce(lambda a, b: a | b, tests)).orderBy("occurred_at", "event_id").limit(n)


def period_label(ts: Column, unit: str) -> Column:
    """'May 2024', 'Week 20, 2024' (ISO week, calendar year) or '2024-05-15'."""
    if unit == "month":
        return F.date_format(ts, "MMMM yyyy")
    if unit == "week":
        return F.concat(F.lit("Week "), F.weekofyear(ts).cast("string"), F.lit(", "), F.year(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM-dd")


def periods(events: DataFrame, entity: str, unit: str = "month", ts: str = "occurred_at", kind: str = "event_type", milestone: str = "is_milestone") -> DataFrame:
    """entity, period, n_events, n_milestones, kinds (event type -> how many), first_at. Types are counted before they are gathered."""
    label = period_label(F.col(ts), unit)
    by = events.groupBy(entity, label.alias("period"), kind).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(milestone)).alias("_m"), F.min(ts).alias("_at"))
    return by.groupBy(entity, "period").agg(F.sum("_n").alias("n_events"), F.sum("_m").alias("n_milestones"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias("kinds"), F.min("_at").alias("first_at"))


def full_text(rows: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """Rows whose text holds all the words (as tokens; without stemming)."""
    wanted = X.query_terms(words)
    found = X.tokens(F.col(text_col))
    return rows.where(reduce(lambda a, b: a & b, (F.array_contains(found, w) for w in wanted), F.lit(True)))


def where_given(rows: DataFrame, **tests) -> DataFrame:
    """Only the tests that are given: None is no test, a list is any of, a pair (low, high) is a range, a string starting with ~ is a
    case-insensitive substring, anything else equality."""
    for name, value in tests.items():
        c = F.col(name)
        if isinstance(value, tuple):
            low, high = value
            rows = rows if low is None else rows.where(c >= low)
            rows = rows if high is None else rows.where(c <= high)
        elif isinstance(value, list):
            rows = rows.where(c.isin(*value))
        elif isinstance(value, str) and value.startswith("~"):
            rows = rows.where(F.lower(c).contains(value[1:].lower()))
        elif value is not None:
            rows = rows.where(c == value)
    return rows


def added(entities: DataFrame, items: DataFrame, key: str, counter: str) -> DataFrame:
    """Entities with a counter raised by the distinct items (key, item_id) that were added."""
    n = items.select(key, "item_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return entities.join(n, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def flagged(views_: DataFrame, silence: int = 30) -> DataFrame:
    """Views with the reasons why they need attention, and all of it as JSON."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("overdue_commitments") > 0, F.concat(F.col("overdue_commitments").cast("string"), F.lit(" overdue commitment(s)"))),
            F.when(F.col("critical_risks") > 0, F.concat(F.col("critical_risks").cast("string"), F.lit(" critical risk(s)"))),
            F.when(F.col("days_since_contact") > silence, F.concat(F.lit("no contact for "), F.col("days_since_contact").cast("string"), F.lit(" days"))),
        )
    )
    out = views_.withColumn("reasons", reasons).withColumn("needs_attention", F.size("reasons") > 0)
    return out.withColumn("context", F.to_json(F.struct(*out.columns)))


def profile(entities: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Entities with each part's rows per key as a sorted array of structs; parts are few rows per entity (capped before)."""
    out = entities
    for name, rows in parts.items():
        cols = [c for c in rows.columns if c != key]
        out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{rows.select(F.struct(*cols).alias('s')).schema['s'].dataType.simpleString()}>")))
    return out


def through(left: DataFrame, junction: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables that a junction (left_key, right_key) ties together."""
    return left.join(junction.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def holding(rows: DataFrame, array_col: str, **wanted: str) -> DataFrame:
    """Rows whose array of structs has an element with all the wanted values."""
    return rows.where(F.exists(array_col, lambda x: reduce(lambda a, b: a & b, (x[k] == v for k, v in wanted.items()))))


def paged(rows: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """A page of rows with the total number of rows on each."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(n).join(F.broadcast(total))


def index_of(**kinds: tuple[DataFrame, str, str]) -> DataFrame:
    """entity_type, entity_id, item_id over several tables (rows, entity column, item column): who has which commitments or risks."""
    parts = [rows.select(F.lit(kind).alias("entity_type"), F.col(entity).cast("string").alias("entity_id"), F.col(item).cast("string").alias("item_id")).where("entity_id is not null") for kind, (rows, entity, item) in kinds.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def gauges(**tables: DataFrame) -> DataFrame:
    """name, value: how many rows each table has."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value") for name, rows in tables.items()])


def by_role(people: Column, role: str) -> Column:
    """The first participant (struct with role) of a role, else the first at all."""
    return F.coalesce(F.get(F.filter(people, lambda p: p["role"] == role), 0), F.get(people, 0))


def as_document(rows: DataFrame, id_col: str) -> DataFrame:
    """id, document: a row as JSON, nulls left out; read_document() takes it back."""
    return rows.select(id_col, F.to_json(F.struct(*rows.columns)).alias("document"))


def read_document(documents: DataFrame, schema: str) -> DataFrame:
    return documents.select(F.from_json("document", schema).alias("d")).select("d.*")


def pending(chunks: DataFrame, embedded: DataFrame, n: int = 1000) -> DataFrame:
    """The first n chunks without a vector."""
    return chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(n)


def embedded(chunks: DataFrame, dimension: int = 64) -> DataFrame:
    """chunk_id, vector by the stub model; a vector of another dimension is an error."""
    rows = chunks.select("chunk_id", X.stub_embedding(F.col("text"), dimension).alias("vector"))
    return rows.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit("wrong dimension"))))
