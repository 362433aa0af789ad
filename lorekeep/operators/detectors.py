"""Rule-based detectors over activity, commitments and relationships. Every operator takes an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X


def mark_overdue(items: DataFrame, status: str, due: str, as_of: Column, open_states=("open", "in_progress")) -> DataFrame:
    late = F.col(status).isin(*open_states) & (F.col(due) < as_of)
    return items.withColumns({"status_now": F.when(late, "overdue").otherwise(F.col(status)), "days_overdue": F.when(late, F.datediff(as_of, F.col(due))).otherwise(0)})


def period_change(events: DataFrame, entity: str, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    """Events in the last `days` and in the `days` before, and the change in percent."""
    age = F.datediff(as_of, F.col(ts))
    now, before = F.count_if((age >= 0) & (age < days)), F.count_if((age >= days) & (age < 2 * days))
    out = events.groupBy(entity).agg(now.alias("n_now"), before.alias("n_before"), F.max(ts).alias("last_at"))
    return out.withColumn("change_pct", F.when(F.col("n_before") > 0, (F.col("n_now") - F.col("n_before")) * 100.0 / F.col("n_before")))


def spikes(changes: DataFrame, least: float = 50, high: float = 100) -> DataFrame:
    return changes.where(F.col("change_pct") >= least).withColumn("severity", F.when(F.col("change_pct") >= high, "high").otherwise("medium"))


def drops(changes: DataFrame, least: float = 40, high: float = 60, critical: float = 80) -> DataFrame:
    c = F.col("change_pct")
    return changes.where(c <= -least).withColumn("severity", F.when(c <= -critical, "critical").when(c <= -high, "high").otherwise("medium"))


def silences(last: DataFrame, last_at: str, kind: str, as_of: Column, limits: dict[str, int] = C.SILENCE_DAYS) -> DataFrame:
    """Entities not heard of for longer than their kind allows."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(kind)], F.lit(limits["default"]))
    return last.withColumns({"silence_days": F.datediff(as_of, F.col(last_at)), "limit_days": limit}).where("silence_days >= limit_days")


def drift(projects: DataFrame, due: str, as_of: Column) -> DataFrame:
    days = F.datediff(as_of, F.col(due))
    return projects.withColumn("drift_days", days).where("drift_days >= 7").withColumn("severity", F.when(F.col("drift_days") >= 30, "critical").when(F.col("drift_days") >= 14, "high").otherwise("medium"))


def overdue_by(items: DataFrame, owner: str) -> DataFrame:
    """Overdue items per owner; no owner is 'Unknown'."""
    return items.where("status_now = 'overdue'").groupBy(F.coalesce(F.col(owner).cast("string"), F.lit("Unknown")).alias("owner")).agg(F.count(F.lit(1)).alias("n_overdue"), F.max("days_overdue").alias("max_days"))


def negative_pattern(messages: DataFrame, entity: str, text_col: str, bank: list[str] = C.NEGATIVE_WORDS, least: int = 3, high: int = 5) -> DataFrame:
    bad = messages.where(X.any_of(F.lower(F.col(text_col)), bank)).groupBy(entity).agg(F.count(F.lit(1)).alias("n_negative"))
    return bad.where(F.col("n_negative") >= least).withColumn("severity", F.when(F.col("n_negative") >= high, "high").otherwise("medium"))


def health(rows: DataFrame) -> DataFrame:
    """rows: silence_days, n_overdue, n_risks, n_escalations, trend_penalty -> score in 0..1 and band."""
    score = C.HEALTH_BASE - X.silence_penalty(F.col("silence_days")) - C.OVERDUE_PENALTY * F.col("n_overdue") - C.RISK_PENALTY * F.col("n_risks") - C.ESCALATION_PENALTY * F.col("n_escalations") - F.col("trend_penalty")
    out = rows.withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return out.withColumn("health", X.band(F.col("health_score"), C.HEALTH_BANDS))


def priority(rows: DataFrame) -> DataFrame:
    """rows: the five factors by name -> weighted score and level."""
    score = sum((w * F.col(k) for k, w in C.PRIORITY_WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("priority_score", score).withColumn("priority", X.band(F.col("priority_score"), [("HIGH", C.PRIORITY_HIGH), ("MEDIUM", C.PRIORITY_MEDIUM), ("LOW", 0.0)]))


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union history and reduce by key: the row with the largest `order` per key."""
    both = current.unionByName(fresh)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def severity_rank(col: Column) -> Column:
    out = F.lit(len(C.SEVERITIES))
    for i, s in enumerate(C.SEVERITIES):
        out = F.when(col == s, i).otherwise(out)
    return out


def raise_severity(found: DataFrame, keys: list[str]) -> DataFrame:
    """Several finds of one risk: evidence gathered, severity only rises."""
    worst = F.min(severity_rank(F.col("severity")))
    return found.groupBy(*keys).agg(F.array(*map(F.lit, C.SEVERITIES))[worst].alias("severity"), F.count(F.lit(1)).alias("n_evidence"))


def evaluated(companies: DataFrame, scored: DataFrame, as_of: Column, keep: int = C.HEALTH_HISTORY) -> DataFrame:
    """Companies (company, health, health_history: array of (at, score, health)) with their new scores (company, health_score, health):
    old_health, health, changed, and the history with the last `keep` entries."""
    new = scored.select("company", F.col("health_score").alias("_s"), F.col("health").alias("_h"))
    rows = companies.join(new, "company")
    entry = F.struct(as_of.alias("at"), F.col("_s").alias("score"), F.col("_h").alias("health"))
    longer = F.concat(F.coalesce("health_history", F.array().cast("array<struct<at:timestamp_ntz,score:double,health:string>>")), F.array(entry))
    kept = F.slice(longer, F.greatest(F.size(longer) - keep, F.lit(0)) + 1, keep)
    return rows.select("company", F.col("health").alias("old_health"), F.col("_h").alias("health"), F.round("_s", 2).alias("health_score"), (~F.col("health").eqNullSafe(F.col("_h"))).alias("changed"), kept.alias("health_history"))


def requiring_attention(companies: DataFrame) -> DataFrame:
    """At risk or in need of attention, the worst first."""
    return companies.where("health in ('attention_required', 'at_risk')").orderBy("health_score", "company")


def running_totals(totals: DataFrame, interactions: DataFrame) -> DataFrame:
    """Totals per company (n, last_at, response_hours) after more interactions (company, occurred_at, response_hours): counts add up, the
    mean response time weighs all that have one (n_timed)."""
    fresh = interactions.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.max("occurred_at").alias("last_at"), F.count("response_hours").alias("n_timed"), F.avg("response_hours").alias("response_hours"))
    both = totals.select("company", "n", "last_at", "n_timed", "response_hours").unionByName(fresh)
    mean = F.sum(F.col("response_hours") * F.col("n_timed")) / F.nullif(F.sum("n_timed"), F.lit(0))
    return both.groupBy("company").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"), mean.alias("response_hours"), F.sum("n_timed").alias("n_timed"))


def active_summary(*found: DataFrame) -> DataFrame:
    """Escalations of all detectors (signal_type, company, severity): how many of each type are active, by severity."""
    rows = found[0].select("signal_type", "company", "severity")
    for more in found[1:]:
        rows = rows.unionByName(more.select("signal_type", "company", "severity"))
    return rows.distinct().groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES])
