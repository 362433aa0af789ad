"""What needs attention: signals, escalations, derived risks, priorities and the daily briefing. Every operator takes an explicit as_of.

Tables, as far as an operator names them: companies (company, kind, health, health_score, silence_days, response_hours, impact, rank),
commitments (commitment_id, company, commitment_type, status, due, owner, text, updated_at), escalations (escalation_id, company,
signal_type, title, severity, is_active), risks (risk_id, company, title, category, severity, risk_score, first_at, evaluated_at,
is_active).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .commitments import signals
from .detectors import priority, severity_rank

_SIGNAL = ("signal_type", "entity", "severity", "current_value", "change_pct", "title")


def by_severity(rows: DataFrame, *then: Column) -> DataFrame:
    """Critical first."""
    return rows.orderBy(severity_rank(F.col("severity")), *then)


def _signal(rows: DataFrame, kind: str, entity: str, severity: Column, title: Column, value: Column | None = None, change: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(F.lit(kind).alias("signal_type"), F.col(entity).alias("entity"), severity.alias("severity"), (none if value is None else value.cast("double")).alias("current_value"), (none if change is None else change.cast("double")).alias("change_pct"), title.alias("title"))


def delayed_responses(companies: DataFrame, most: float = 72, usual: float = 24) -> DataFrame:
    """Companies that take longer than `most` hours to answer on average; high above five days."""
    hours = F.col("response_hours")
    days = F.round(hours / 24, 1)
    rows = companies.where(hours > most)
    return _signal(rows, "delayed_response", "company", F.when(days > 5, "high").otherwise("medium"), F.concat(F.lit("Slow responses from "), "company", F.lit(": avg "), days.cast("string"), F.lit(" days")), hours, (hours - usual) / usual * 100)


def escalation_increase(escalations: DataFrame, least: int = 2) -> DataFrame:
    """Companies with several active escalations: high from three, critical from four."""
    n = escalations.where("is_active and company <> ''").groupBy("company").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return _signal(n, "increased_escalations", "company", F.when(F.col("n") >= 4, "critical").when(F.col("n") >= 3, "high").otherwise("medium"), F.concat(F.col("n").cast("string"), F.lit(" active escalations with "), "company"), F.col("n"))


def new_risks(risks: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Active high and critical risks first seen in the last hours."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("first_at").cast("timestamp"))
    rows = risks.where(F.col("is_active") & F.col("severity").isin("high", "critical") & (age <= hours * 3600)).withColumn("_e", F.coalesce("company", F.lit("Organization")))
    return _signal(rows, "new_risk", "_e", F.col("severity"), F.concat(F.lit("New "), "severity", F.lit(" risk: "), F.substring("title", 1, 80)))


def deterioration(companies: DataFrame) -> DataFrame:
    rows = companies.where("health = 'at_risk'")
    return _signal(rows, "relationship_deterioration", "company", F.lit("high"), F.concat(F.lit("Relationship at risk: "), "company"), F.col("health_score"))


def all_signals(*found: DataFrame) -> DataFrame:
    """A run of all detectors: one row per signal type and entity, the most severe."""
    rows = found[0].select(*_SIGNAL)
    for more in found[1:]:
        rows = rows.unionByName(more.select(*_SIGNAL))
    w = Window.partitionBy("signal_type", "entity").orderBy(severity_rank(F.col("severity")), "title")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def run_summary(signals_found: DataFrame) -> DataFrame:
    return signals_found.groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"))


def repeated_followups(interactions: DataFrame, as_of: Column, days: int = 30, least: int = 2, patterns: list[str] = C.STALL) -> DataFrame:
    """Companies chased `least` times or more in the last days: how often, when first and last."""
    text = F.concat_ws(" ", "subject", "summary")
    rows = interactions.where((F.col("occurred_at") <= as_of) & (F.col("occurred_at") >= F.timestamp_seconds(F.unix_timestamp(as_of.cast("timestamp")) - days * 86400).cast("timestamp_ntz")))
    rows = rows.where((F.size(signals(text, patterns)) > 0) & F.col("company").isNotNull())
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("n_followups"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")).where(F.col("n_followups") >= least)


def escalation_score(escalations: DataFrame) -> DataFrame:
    """company -> its worst active escalation's score, with a boost for each further one."""
    score = F.coalesce(F.create_map(*[F.lit(x) for kv in C.ESCALATION_SCORES.items() for x in kv])[F.col("severity")], F.lit(C.ESCALATION_OTHER))
    by = escalations.where("is_active").groupBy("company").agg(F.max(score).alias("s"), F.count(F.lit(1)).alias("n"))
    return by.select("company", F.least(F.lit(1.0), F.col("s") + F.least((F.col("n") - 1) * C.ESCALATION_STEP, F.lit(C.ESCALATION_BOOST))).alias("escalation_level"))


def risks_from_commitments(commitments: DataFrame) -> DataFrame:
    """Overdue external dependencies per company (regulatory where the name says so, high from three), and each overdue approval."""
    late = commitments.where("status = 'overdue'")
    who = F.coalesce("company", F.lit("Unknown"))
    waits = late.where("commitment_type = 'external_dependency'").groupBy(who.alias("company")).agg(F.count(F.lit(1)).alias("n"))
    waits = waits.select(F.concat(F.lit("Unresolved external dependencies — "), "company").alias("title"), F.when(F.lower("company").contains("regulator"), "regulatory").otherwise("vendor").alias("category"), F.when(F.col("n") >= 3, "high").otherwise("medium").alias("severity"), "company", F.col("n").alias("n_evidence"))
    asked = late.where("commitment_type = 'approval'").select(F.concat(F.lit("Overdue approval: "), F.substring("text", 1, 100)).alias("title"), F.lit("approval").alias("category"), F.lit("high").alias("severity"), "company", F.lit(1).cast("long").alias("n_evidence"))
    return waits.unionByName(asked)


def risks_from_escalations(escalations: DataFrame) -> DataFrame:
    rows = escalations.where(F.col("is_active") & F.col("severity").isin("high", "critical"))
    return rows.select(F.concat(F.lit("Escalation risk: "), F.substring("title", 1, 100)).alias("title"), F.lit("vendor").alias("category"), "severity", "company", F.lit(1).cast("long").alias("n_evidence"))


def risk_summary(risks: DataFrame) -> DataFrame:
    active = risks.where("is_active")
    return active.agg(F.count(F.lit(1)).alias("total_active"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))


def _factors(rows: DataFrame, companies: DataFrame, escalations: DataFrame, as_of: Column, due: Column) -> DataFrame:
    known = companies.select("company", "impact", "rank")
    rows = rows.join(known, "company", "left").join(escalation_score(escalations), "company", "left")
    never = F.lit(False)
    return priority(rows.withColumns({
        "ceo_involvement": X.ceo_involvement(F.col("text"), never, never), "revenue_impact": X.revenue(F.col("text"), F.col("impact")), "deadline_urgency": X.urgency(X.days_between(due, as_of)),
        "escalation_level": F.coalesce("escalation_level", F.lit(0.0)), "relationship_importance": X.relationship_importance(F.col("text"), F.col("rank")),
    }))


def priorities(commitments: DataFrame, risks: DataFrame, companies: DataFrame, escalations: DataFrame, as_of: Column) -> DataFrame:
    """entity_type, entity_id, company, title, priority_score, priority of live commitments and active risks; a risk counts as due
    by its severity (0, 3, 14, 30 days) and blends in its own score."""
    live = commitments.where(F.col("status").isin("open", "in_progress", "overdue")).select(F.lit("commitment").alias("entity_type"), F.col("commitment_id").alias("entity_id"), "company", "text", "due", F.lit(None).cast("double").alias("own"))
    days = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 14).when(F.col("severity") == "low", 30)
    due = F.timestamp_seconds(F.unix_timestamp(as_of.cast("timestamp")) + days * 86400).cast("timestamp_ntz")
    at = risks.where("is_active").select(F.lit("risk").alias("entity_type"), F.col("risk_id").alias("entity_id"), "company", F.col("title").alias("text"), due.alias("due"), F.col("risk_score").cast("double").alias("own"))
    scored = _factors(live.unionByName(at), companies, escalations, as_of, F.col("due"))
    score = F.round(F.when(F.col("own").isNull(), F.col("priority_score")).otherwise(F.least(F.lit(1.0), F.col("priority_score") * 0.7 + F.col("own") * 0.3)), 6)
    level = X.band(score, [("HIGH", C.PRIORITY_HIGH), ("MEDIUM", C.PRIORITY_MEDIUM), ("LOW", 0.0)])
    return scored.select("entity_type", "entity_id", "company", F.substring("text", 1, 200).alias("title"), score.alias("priority_score"), level.alias("priority"))


def top_priorities(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.where("priority in ('HIGH', 'MEDIUM')").orderBy(F.desc("priority_score"), "entity_type", "entity_id").limit(n)


def attention(companies: DataFrame, commitments: DataFrame, risks: DataFrame, n: int = 8) -> DataFrame:
    """The relationships in worst health, with what is open there and a line that says why."""
    open_ = commitments.where("status in ('open', 'overdue')").groupBy("company").agg(F.count(F.lit(1)).alias("open_commitments"))
    at = risks.where("is_active").groupBy("company").agg(F.count(F.lit(1)).alias("active_risks"))
    rows = companies.where("health in ('at_risk', 'attention_required')").orderBy("health_score", "company").limit(n)
    rows = rows.join(open_, "company", "left").join(at, "company", "left").fillna(0, ["open_commitments", "active_risks"])
    says = F.concat_ws(
        "; ",
        F.when(F.col("silence_days") > 14, F.concat(F.lit("No contact for "), F.col("silence_days").cast("string"), F.lit(" days"))),
        F.when(F.col("open_commitments") > 0, F.concat(F.col("open_commitments").cast("string"), F.lit(" open commitment(s)"))),
        F.when(F.col("active_risks") > 0, F.concat(F.col("active_risks").cast("string"), F.lit(" active risk(s)"))),
        F.when(F.col("health") == "at_risk", "Relationship at risk"),
    )
    return rows.select("company", "health", "health_score", "open_commitments", "active_risks", F.when(says == "", "Requires monitoring").otherwise(says).alias("summary"))


def briefing(scored: DataFrame, commitments: DataFrame, risks: DataFrame, companies: DataFrame, escalations: DataFrame, interactions: DataFrame, as_of: Column) -> DataFrame:
    """The daily briefing as rows: section, rank, item, detail. Sections: top_priorities, overdue, stalled, open_high, relationships,
    emerging_risks, escalations, activity, focus; each only its few first rows."""
    now = F.unix_timestamp(as_of.cast("timestamp"))
    age = lambda c: now - F.unix_timestamp(F.col(c).cast("timestamp"))
    text = lambda c: F.col(c).cast("string")

    def section(name: str, rows: DataFrame, n: int, order: list, item: Column, detail: Column) -> DataFrame:
        best = rows.orderBy(*order).limit(n)
        return best.select(F.lit(name).alias("section"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"), item.alias("item"), detail.alias("detail"))

    own = scored.where("entity_type = 'commitment'").select(F.col("entity_id").alias("commitment_id"), "priority_score")
    rated = commitments.join(own, "commitment_id", "left")
    fresh = risks.where("is_active").where(age("first_at") <= 48 * 3600).orderBy(F.desc("risk_score"), "risk_id").limit(5)
    worst = risks.where("is_active and severity = 'critical'").orderBy(F.desc("evaluated_at"), "risk_id").limit(3)
    emerging = fresh.unionByName(worst).dropDuplicates(["risk_id"])
    overdue = commitments.where("status = 'overdue'").orderBy("due", "commitment_id").limit(10)
    bad, alarms = attention(companies, commitments, risks), escalations.where("is_active")
    parts = [
        section("top_priorities", top_priorities(scored, 5), 5, [F.desc("priority_score"), "entity_type", "entity_id"], F.col("title"), F.col("priority")),
        section("overdue", overdue, 10, ["due", "commitment_id"], F.col("text"), F.coalesce("company", F.lit(""))),
        section("stalled", commitments.where("status = 'in_progress'").where(age("updated_at") > 7 * 86400), 5, ["updated_at", "commitment_id"], F.col("text"), F.coalesce("company", F.lit(""))),
        section("open_high", rated.where("status = 'open' and priority_score >= 0.65"), 5, [F.desc("priority_score"), "commitment_id"], F.col("text"), F.coalesce("company", F.lit(""))),
        section("relationships", bad, 8, ["health_score", "company"], F.col("company"), F.col("summary")),
        section("emerging_risks", emerging, 8, [severity_rank(F.col("severity")), F.desc("risk_score"), "risk_id"], F.col("title"), F.when(age("first_at") <= 48 * 3600, F.concat("severity", F.lit(", new"))).otherwise(F.col("severity"))),
        section("escalations", alarms, 10, [severity_rank(F.col("severity")), "escalation_id"], F.col("title"), F.col("severity")),
        section("activity", interactions.where("summary is not null").where((age("occurred_at") >= 0) & (age("occurred_at") <= 86400)), 10, [F.desc("occurred_at"), "summary"], F.col("summary"), F.coalesce("company", F.lit(""))),
    ]
    counts = overdue.agg(F.count(F.lit(1)).alias("late")).crossJoin(bad.where("health = 'at_risk'").agg(F.array_sort(F.collect_list(F.struct("health_score", "company"))).alias("lost"))).crossJoin(emerging.where("severity = 'critical'").agg(F.count(F.lit(1)).alias("grave"))).crossJoin(alarms.agg(F.count(F.lit(1)).alias("alarms")))  # four single rows
    names = F.array_join(F.transform(F.slice("lost", 1, 3), lambda x: x["company"]), ", ")
    rules = [
        ("late", F.col("late") > 0, "Overdue Commitments", F.concat(text("late"), F.lit(" commitment(s) past due date require resolution"))),
        ("lost", F.size("lost") > 0, "Relationship Recovery", F.concat(F.lit("Relationship(s) at risk: "), names)),
        ("grave", F.col("grave") > 0, "Critical Risk Mitigation", F.concat(text("grave"), F.lit(" critical risk(s) require immediate attention"))),
        ("alarms", F.col("alarms") > 0, "Escalation Resolution", F.concat(text("alarms"), F.lit(" active escalation(s) require executive decision"))),
    ]
    shown = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(area).alias("item"), reason.alias("detail"))) for _, test, area, reason in rules]))
    focus = counts.select(F.posexplode(shown).alias("p", "f")).select(F.lit("focus").alias("section"), (F.col("p") + 1).alias("rank"), "f.item", "f.detail")
    out = focus
    for part in parts:
        out = out.unionByName(part)
    return out
