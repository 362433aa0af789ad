"""Composed queries: from question to cited context, the life of commitments, risks, fusion, attention.

Those with the real rule banks run on small built-in tables (samples.py); their twins are SQL over the same rows, or the rows
expected, written down.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..operators import answering as A
from ..operators import commitments as K
from ..operators import extraction as T
from ..operators import fusion as M
from ..operators import retrieval as V
from ..operators import watch as W
from . import samples as S
from .base import Literal, example, expected, q, quoted, spread, table


def now():
    return F.lit(S.NOW).cast("timestamp_ntz")


# ------------------------------------------------------------------ commitments and risks
@q(
    S.DEADLINES.dealt(
        "id long; deadline date",
        [
            (1, "2024-05-17"), (2, "2024-05-15"), (3, "2024-05-17"), (4, "2024-05-31"), (5, "2024-06-30"), (6, "2024-06-01"), (7, "2024-12-25"), (8, "2024-05-22"), (9, "2024-05-17"), (10, "2024-05-18"), (11, "2024-05-29"),
            (12, "2024-05-17"), (13, "2024-05-16"), (14, "2024-05-15"), (15, "2024-05-20"), (16, "2024-06-30"), (17, "2024-05-15"), (18, None), (19, None), (20, None), (21, None),
        ],
    )
)
def spoken_deadlines(spark, sf):
    return S.DEADLINES.over(spark, sf).select("id", K.deadline(F.col("text"), now()).alias("deadline"))


def _counts(patterns: list[str], text: str = "t") -> str:
    return " + ".join(f"regexp_matches({text}, {quoted(p)})::INT" for p in patterns)


_SQL_DETECT = f"""{S.MESSAGES.cte}, l AS (SELECT msg_id, lower(text) AS t FROM messages),
n AS (SELECT msg_id, t, {", ".join(f"{_counts(ps)} AS {k}" for k, ps in C.COMMITMENT_PATTERNS.items())}, regexp_matches(t, {quoted(C.FUTURE)}) AS future, regexp_matches(t, {quoted(C.ACTION)}) AS act,
  {_counts(C.DEADLINES)} > 0 AS dated, regexp_matches(t, {quoted(C.OWN)}) AS own FROM l),
g AS (SELECT *, greatest({", ".join(C.COMMITMENT_PATTERNS)}) AS n_patterns FROM n),
s AS (SELECT *, round(least(0.2 * n_patterns, 0.5) + 0.15 * future::INT + 0.15 * act::INT + 0.1 * dated::INT + 0.1 * own::INT, 6)::DOUBLE AS confidence FROM g)"""


@q(
    f"""WITH {_SQL_DETECT} SELECT msg_id, CASE {" ".join(f"WHEN {k} = n_patterns THEN '{k}'" for k in C.COMMITMENT_PATTERNS)} END AS commitment_type, n_patterns, confidence
FROM s WHERE (future OR act) AND n_patterns > 0 AND confidence >= 0.2"""
)
def commitment_candidates(spark, sf):
    return K.detect(S.MESSAGES.frame(spark, sf), now(), "text").select("msg_id", "commitment_type", "n_patterns", "confidence")


@q(
    f"""WITH {S.MESSAGES.cte}, d AS (SELECT msg_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM messages),
l AS (SELECT msg_id, lower(sentence) AS t FROM d WHERE length(sentence) >= 10), n AS (SELECT msg_id, greatest({", ".join(_counts(ps) for ps in C.COMMITMENT_PATTERNS.values())}) AS k, regexp_matches(t, {quoted(C.FUTURE)}) OR regexp_matches(t, {quoted(C.ACTION)}) AS c FROM l)
SELECT msg_id, count(*) AS n_new, 'open' AS status FROM n WHERE k > 0 AND c GROUP BY msg_id"""
)
def commitments_extracted(spark, sf):
    found = K.extract(S.MESSAGES.frame(spark, sf), now(), "msg_id")
    first = K.history(found, now()).where("old_status is null").join(found, "commitment_id")
    return first.groupBy("msg_id").agg(F.count(F.lit(1)).alias("n_new"), F.min("new_status").alias("status"))


@q(
    S.SAMPLE_FOLLOWUPS.dealt(
        "sid long; resolved array<string>; stalled array<string>",
        [
            (1, [], ["any update"]), (2, ["sent", "we have sent"], []), (3, [], ["any news"]), (4, [], ["reminder"]), (5, ["confirmed"], []), (6, ["delivered"], []), (7, ["sent"], []),
        ],
    )
)
def resolution_signals(spark, sf):
    f = S.SAMPLE_FOLLOWUPS.over(spark, sf)
    return f.select("sid", K.signals(F.col("text"), C.RESOLUTION, C.NEGATED).alias("resolved"), K.signals(F.col("text"), C.STALL).alias("stalled"))


_LONG = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 4))"
_SQL_MATCH = f"""{S.FOLLOWUPS.cte}, {S.COMMITMENTS.cte},
a AS (SELECT sid, company, {_LONG.format("text")} AS w FROM followups), b AS (SELECT commitment_id, company, status, {_LONG.format("text")} AS w FROM commitments WHERE status IN ('open', 'in_progress')),
x AS (SELECT sid, commitment_id, status, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS likeness FROM a, b WHERE a.company IS NULL OR a.company = b.company),
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY likeness DESC, commitment_id) AS k FROM x WHERE likeness > 0.3)"""


@q(f"WITH {_SQL_MATCH} SELECT sid, commitment_id, status, round(likeness, 6)::DOUBLE AS likeness FROM r WHERE k = 1")
def commitment_matches(spark, sf):
    found = K.matched(S.FOLLOWUPS.frame(spark, sf), S.COMMITMENTS.frame(spark, sf), "sid")
    return found.withColumn("likeness", F.round("likeness", 6))


@example(
    expected(
        "commitment_id string; old_status string; new_status string; reason string; sid long",
        [
            ("c1", "open", "in_progress", "Follow-up detected: any update", 1), ("c1", "in_progress", "resolved", "Resolution evidence detected: sent, we have sent", 2), ("c9", "open", "resolved", "Resolution evidence detected: confirmed", 5),
        ],
    )
)
def commitment_transitions(spark, sf):
    return K.transitions(S.SAMPLE_FOLLOWUPS.frame(spark, sf), S.SAMPLE_COMMITMENTS.frame(spark, sf), "sid").select("commitment_id", "old_status", "new_status", "reason", "sid")


@example(expected("status string; n long", [("resolved", 3), ("overdue", 5), ("in_progress", 1)]))
def commitments_after_followups(spark, sf):
    c = S.SAMPLE_COMMITMENTS.frame(spark, sf)
    moved = K.transitions(S.SAMPLE_FOLLOWUPS.frame(spark, sf), c, "sid")
    return K.apply_transitions(c, moved).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_EDGED = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"


_FAR = "x" * 120
_RISKY = Literal("texts", "id long; text string", [
    (1, "Urgent: the vendor delayed again, approval pending."), (2, f"The launch delayed. {_FAR} {_FAR} The release blocked by QA."), (3, "A penalty applies."), (4, "All is well."), (5, None), (6, ""),
])


@q(
    _RISKY.dealt(
        "id long; category string; title string; match_no int; match_text string; severity string; confidence double",
        [
            (1, "vendor", "Vendor delivery delay", 0, "vendor delay", "high", 0.6), (1, "approval", "Approval pending", 0, "approval pending", "high", 0.6),
            (2, "deployment", "Deployment delay", 0, "launch delayed", "medium", 0.5), (2, "deployment", "Deployment delay", 1, "release blocked", "high", 0.5),
            (3, "contract", "Contractual penalty risk", 0, "penalty", "medium", 0.5),
        ],
    )
)
def risk_scan(spark, sf):
    found = T.risks(_RISKY.over(spark, sf), "id", "text")
    return found.select("id", "category", "title", "match_no", "match_text", "severity", F.round("confidence", 6).alias("confidence"))


@q(
    f"""WITH {S.COMMITMENTS.cte}, o AS (SELECT * FROM commitments WHERE status = 'overdue'), e AS (SELECT coalesce(company, 'Unknown') AS company, count(*) AS n FROM o WHERE commitment_type = 'external_dependency' GROUP BY 1)
SELECT 'Unresolved external dependencies — ' || company AS title, CASE WHEN contains(lower(company), 'regulator') THEN 'regulatory' ELSE 'vendor' END AS category, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS severity, company, n AS n_evidence FROM e
UNION ALL SELECT 'Overdue approval: ' || text[:100], 'approval', 'high', company, 1 FROM o WHERE commitment_type = 'approval'"""
)
def risks_from_commitments(spark, sf):
    return W.risks_from_commitments(S.COMMITMENTS.frame(spark, sf))


@q(f"WITH {S.ESCALATIONS.cte} SELECT 'Escalation risk: ' || title[:100] AS title, 'vendor' AS category, severity, company, 1::BIGINT AS n_evidence FROM escalations WHERE is_active AND severity IN ('high', 'critical')")
def risks_from_escalations(spark, sf):
    return W.risks_from_escalations(S.ESCALATIONS.frame(spark, sf))


@q(f"WITH {S.RISKS.cte} SELECT count(*) AS total_active, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM risks WHERE is_active")
def risk_evaluation(spark, sf):
    return W.risk_summary(S.RISKS.frame(spark, sf))


# ------------------------------------------------------------------ signals, priorities, briefing
_SQL_SIGNALS = f"""{S.COMPANIES.cte}, {S.ESCALATIONS.cte}, {S.RISKS.cte},
e AS (SELECT company, count(*) AS n FROM escalations WHERE is_active AND company <> '' GROUP BY 1),
f0 AS (SELECT 'delayed_response' AS signal_type, company AS entity, CASE WHEN round(response_hours / 24, 1) > 5 THEN 'high' ELSE 'medium' END AS severity, response_hours AS current_value FROM companies WHERE response_hours > 72
  UNION ALL SELECT 'increased_escalations', company, CASE WHEN n >= 4 THEN 'critical' WHEN n >= 3 THEN 'high' ELSE 'medium' END, n FROM e WHERE n >= 2
  UNION ALL SELECT 'new_risk', coalesce(company, 'Organization'), severity, NULL FROM risks WHERE is_active AND severity IN ('high', 'critical') AND first_at >= TIMESTAMP '{S.NOW}' - INTERVAL 24 HOUR
  UNION ALL SELECT 'relationship_deterioration', company, 'high', health_score FROM companies WHERE health = 'at_risk'),
f AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY signal_type, entity ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity)) = 1)"""


def _signals(spark, sf):
    c, e, r = S.COMPANIES.frame(spark, sf), S.ESCALATIONS.frame(spark, sf), S.RISKS.frame(spark, sf)
    return W.all_signals(W.delayed_responses(c), W.escalation_increase(e), W.new_risks(r, now()), W.deterioration(c))


@q(f"WITH {_SQL_SIGNALS} SELECT signal_type, entity, severity, current_value::DOUBLE AS current_value FROM f")
def executive_signals(spark, sf):
    return W.by_severity(_signals(spark, sf), F.col("entity")).select("signal_type", "entity", "severity", "current_value")


@q(f"WITH {_SQL_SIGNALS} SELECT signal_type, count(*) AS n FROM f GROUP BY 1")
def signal_run_summary(spark, sf):
    return W.run_summary(_signals(spark, sf))


@q(
    f"""WITH {S.INTERACTIONS.cte}, t AS (SELECT company, occurred_at, lower(concat_ws(' ', subject, summary)) AS t FROM interactions WHERE company IS NOT NULL AND occurred_at <= TIMESTAMP '{S.NOW}' AND occurred_at >= TIMESTAMP '{S.NOW}' - INTERVAL 30 DAY)
SELECT company, count(*) AS n_followups, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM t WHERE {_counts(C.STALL)} > 0 GROUP BY 1 HAVING count(*) >= 2"""
)
def repeated_followups(spark, sf):
    return W.repeated_followups(S.INTERACTIONS.frame(spark, sf), now())


_SQL_ESC = """s AS (SELECT company, max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 ELSE 0.3 END) AS m, count(*) AS n FROM escalations WHERE is_active GROUP BY 1),
esc AS (SELECT company, least(1.0, m + least(0.1 * (n - 1), 0.2)) AS escalation_level FROM s)"""


@q(f"WITH {S.ESCALATIONS.cte}, {_SQL_ESC} SELECT company, round(escalation_level, 6)::DOUBLE AS escalation_level FROM esc")
def escalation_levels(spark, sf):
    return W.escalation_score(S.ESCALATIONS.frame(spark, sf)).withColumn("escalation_level", F.round("escalation_level", 6))


def _contains(words: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


_URGENT = "CASE WHEN due IS NULL THEN 0.1 WHEN d < 0 THEN 1.0 WHEN d <= 0 THEN 0.95 WHEN d <= 1 THEN 0.9 WHEN d <= 3 THEN 0.8 WHEN d <= 7 THEN 0.7 WHEN d <= 14 THEN 0.55 WHEN d <= 30 THEN 0.35 ELSE 0.15 END"
_SQL_PRIORITY = f"""{S.COMMITMENTS.cte}, {S.RISKS.cte}, {S.COMPANIES.cte}, {S.ESCALATIONS.cte}, {_SQL_ESC},
i AS (SELECT 'commitment' AS entity_type, commitment_id AS entity_id, company, text, due, NULL::DOUBLE AS own FROM commitments WHERE status IN ('open', 'in_progress', 'overdue')
  UNION ALL SELECT 'risk', risk_id, company, title, TIMESTAMP '{S.NOW}' + to_days(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 3 WHEN 'medium' THEN 14 ELSE 30 END), risk_score FROM risks WHERE is_active),
j AS (SELECT i.*, lower(i.text) AS t, floor((epoch(due) - epoch(TIMESTAMP '{S.NOW}')) / 86400) AS d, impact, rank, escalation_level FROM i LEFT JOIN companies USING (company) LEFT JOIN esc USING (company)),
k AS (SELECT *, 0.25 * CASE WHEN {_contains(C.CEO_WORDS)} THEN 1.0 ELSE 0.0 END
  + 0.25 * CASE WHEN {_contains(C.REVENUE_WORDS)} THEN CASE {" ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN {s}" for p, s in C.REVENUE_LADDER)} ELSE 0.6 END WHEN impact = 'high' THEN 0.9 WHEN impact = 'medium' THEN 0.5 ELSE 0.2 END
  + 0.2 * ({_URGENT}) + 0.2 * coalesce(escalation_level, 0) + 0.1 * CASE WHEN {_contains(C.KEY_RELATIONSHIP_WORDS)} THEN 0.9 WHEN rank = 'high' THEN 1.0 WHEN rank = 'medium' THEN 0.6 ELSE 0.2 END AS s FROM j),
p AS (SELECT entity_type, entity_id, company, text[:200] AS title, round(CASE WHEN own IS NULL THEN s ELSE least(1.0, 0.7 * s + 0.3 * own) END, 6)::DOUBLE AS priority_score FROM k),
pr AS (SELECT *, CASE WHEN priority_score >= 0.65 THEN 'HIGH' WHEN priority_score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM p)"""


def _sample_priorities(spark):
    return W.priorities(*(t.frame(spark) for t in (S.SAMPLE_COMMITMENTS, S.SAMPLE_RISKS, S.SAMPLE_COMPANIES, S.SAMPLE_ESCALATIONS)), now())


def _priorities(spark, sf):
    return W.priorities(S.COMMITMENTS.frame(spark, sf), S.RISKS.frame(spark, sf), S.COMPANIES.frame(spark, sf), S.ESCALATIONS.frame(spark, sf), now())


@q(f"WITH {_SQL_PRIORITY} SELECT * FROM pr")
def priorities(spark, sf):
    return _priorities(spark, sf)


@q(f"WITH {_SQL_PRIORITY} SELECT entity_type, entity_id, priority_score, priority FROM pr WHERE priority <> 'LOW' ORDER BY priority_score DESC, entity_type, entity_id LIMIT 5")
def top_priorities(spark, sf):
    return W.top_priorities(_priorities(spark, sf), 5).select("entity_type", "entity_id", "priority_score", "priority")


@q(
    f"""WITH {S.COMPANIES.cte}, {S.COMMITMENTS.cte}, {S.RISKS.cte}, o AS (SELECT company, count(*) AS n FROM commitments WHERE status IN ('open', 'overdue') GROUP BY 1), r AS (SELECT company, count(*) AS n FROM risks WHERE is_active GROUP BY 1),
x AS (SELECT c.*, coalesce(o.n, 0) AS open_commitments, coalesce(r.n, 0) AS active_risks FROM companies c LEFT JOIN o USING (company) LEFT JOIN r USING (company) WHERE health IN ('at_risk', 'attention_required')),
y AS (SELECT *, concat_ws('; ', CASE WHEN silence_days > 14 THEN 'No contact for ' || silence_days || ' days' END, CASE WHEN open_commitments > 0 THEN open_commitments || ' open commitment(s)' END, CASE WHEN active_risks > 0 THEN active_risks || ' active risk(s)' END, CASE WHEN health = 'at_risk' THEN 'Relationship at risk' END) AS s FROM x)
SELECT company, health, health_score, open_commitments, active_risks, CASE WHEN s = '' THEN 'Requires monitoring' ELSE s END AS summary FROM y ORDER BY health_score LIMIT 8"""
)
def relationships_in_need(spark, sf):
    return W.attention(S.COMPANIES.frame(spark, sf), S.COMMITMENTS.frame(spark, sf), S.RISKS.frame(spark, sf))


@example(
    expected(
        "section string; rank int; item string; detail string",
        [
            ('activity', 1, 'Licence review went well', 'Borealis'),
            ('activity', 2, 'Any update on parts', 'Cedar'),
            ('activity', 3, 'Following up on the proposal', 'Acme'),
            ('emerging_risks', 1, 'SLA breach', 'critical, new'),
            ('emerging_risks', 2, 'Old crisis', 'critical'),
            ('emerging_risks', 3, 'Regulatory attention', 'high, new'),
            ('emerging_risks', 4, 'Approval pending', 'medium, new'),
            ('escalations', 1, 'Overdue at Acme', 'critical'),
            ('escalations', 2, 'Silence at Acme', 'high'),
            ('escalations', 3, 'Tone at Acme', 'medium'),
            ('escalations', 4, 'Drift', 'medium'),
            ('escalations', 5, 'Silence at Delta', 'medium'),
            ('escalations', 6, 'Chasing Delta', 'medium'),
            ('escalations', 7, 'Overdue at Cedar', 'low'),
            ('focus', 1, 'Overdue Commitments', '5 commitment(s) past due date require resolution'),
            ('focus', 2, 'Relationship Recovery', 'Relationship(s) at risk: Delta, Acme'),
            ('focus', 3, 'Critical Risk Mitigation', '2 critical risk(s) require immediate attention'),
            ('focus', 4, 'Escalation Resolution', '7 active escalation(s) require executive decision'),
            ('open_high', 1, 'Send the revised proposal for the board', 'Acme'),
            ('open_high', 2, 'Confirm the $5 million payment to the key client with the ceo', ''),
            ('overdue', 1, 'Regulator must confirm the licence', 'Borealis Regulator'),
            ('overdue', 2, 'Vendor delivers the spare parts', 'Cedar'),
            ('overdue', 3, 'Vendor delivers the cables', 'Cedar'),
            ('overdue', 4, 'Vendor delivers the racks', 'Cedar'),
            ('overdue', 5, 'Approve the budget for the smart meters', 'Acme'),
            ('relationships', 1, 'Delta', 'No contact for 40 days; Relationship at risk'),
            ('relationships', 2, 'Acme', 'No contact for 20 days; 2 open commitment(s); 2 active risk(s); Relationship at risk'),
            ('relationships', 3, 'Elm', 'Requires monitoring'),
            ('relationships', 4, 'Borealis', '1 active risk(s)'),
            ('stalled', 1, 'Schedule the rollout review call', 'Borealis'),
            ('top_priorities', 1, 'Send the revised proposal for the board', 'HIGH'),
            ('top_priorities', 2, 'Confirm the $5 million payment to the key client with the ceo', 'HIGH'),
            ('top_priorities', 3, 'SLA breach', 'HIGH'),
            ('top_priorities', 4, 'Approve the budget for the smart meters', 'HIGH'),
            ('top_priorities', 5, 'Approval pending', 'MEDIUM'),
        ],
    )
)
def briefing_of_samples(spark, sf):
    return W.briefing(_sample_priorities(spark), S.SAMPLE_COMMITMENTS.frame(spark), S.SAMPLE_RISKS.frame(spark), S.SAMPLE_COMPANIES.frame(spark), S.SAMPLE_ESCALATIONS.frame(spark), S.SAMPLE_INTERACTIONS.frame(spark), now())


@q()
def daily_briefing(spark, sf):
    """On all orders, customers and events; the example above says what it should give."""
    scored = _priorities(spark, sf).checkpoint()  # read by two sections
    return W.briefing(scored, *(t.frame(spark, sf) for t in (S.COMMITMENTS, S.RISKS, S.COMPANIES, S.ESCALATIONS, S.INTERACTIONS)), now())


# ------------------------------------------------------------------ from question to cited context
_SPECS = ", ".join(
    f"('{category}', '{strategy}', {total}, '{source}', '{priority}', {C.SOURCE_PRIORITIES.index(priority) * 100 + i}, {n}, {weight})"
    for category, (strategy, _, total, _, sources) in C.PLANS.items()
    for i, (source, priority, n, weight, _) in enumerate(sources)
)


@q(
    f"""WITH qb(question_id, category, temporal) AS (VALUES (1, 'person', 'all_time'), (2, 'company', 'recent'), (3, 'project', 'month'), (4, 'risk', 'quarter'), (5, 'commitment', 'all_time'), (6, 'general', 'all_time')),
qs AS (SELECT d.doc_id AS question_id, category, temporal FROM documents d JOIN qb ON qb.question_id = {S.QUESTIONS.ids!r}[(d.doc_id % {len(S.QUESTIONS.ids)})::INT + 1]),
sp(category, strategy, total, source_type, priority, place, n, w) AS (VALUES {_SPECS})
SELECT question_id::BIGINT AS question_id, category, strategy, source_type, priority, row_number() OVER (PARTITION BY question_id ORDER BY place)::INT AS source_rank,
least(floor(n * CASE temporal WHEN 'recent' THEN 0.5 WHEN 'month' THEN 0.75 WHEN 'all_time' THEN 1.5 ELSE 1.0 END), 30)::INT AS max_results, round(CASE WHEN temporal = 'recent' THEN least(1.0, w + 0.2) ELSE w END, 6)::DOUBLE AS recency_weight FROM qs JOIN sp USING (category)"""
)
def retrieval_plans(spark, sf):
    found = A.plan(T.classify_queries(S.QUESTIONS.over(spark, sf)))
    return found.select("question_id", "category", "strategy", "source_type", "priority", "source_rank", "max_results", F.round("recency_weight", 6).alias("recency_weight"))


_TERMS = ["the", "tion", "there", "der", "que"]
_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_SQL_TOKS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z0-9]+$'))"


@q(
    f"""WITH t AS (SELECT doc_id, {_SQL_TOKS} AS toks FROM documents), l AS (SELECT doc_id, len(toks) AS n, toks FROM t), s AS (SELECT count(*) AS docs, avg(n) AS avg_n FROM l), qt AS (SELECT unnest({_TERMS!r}) AS term),
f AS (SELECT doc_id, n, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM l, qt), g AS (SELECT * FROM f WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM g GROUP BY term),
bm AS (SELECT doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_n))) AS score FROM g JOIN d USING (term), s GROUP BY doc_id),
v AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, {_VECTOR!r}::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
cs AS (SELECT doc_id, greatest(0, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))) AS score FROM v),
rel AS (SELECT DISTINCT doc_id, 1 / 3 AS score FROM documents WHERE doc_id IN (4, 7, 10)),
h AS (SELECT 'keyword' AS mode, doc_id, score FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) UNION ALL SELECT 'semantic', doc_id, score FROM (SELECT * FROM cs ORDER BY score DESC, doc_id LIMIT 20)
  UNION ALL SELECT 'metadata', doc_id, score FROM (SELECT doc_id, ((lang = 'en')::INT + contains(lower(source), 'src1')::INT) / 2.0 AS score FROM documents WHERE lang = 'en' OR contains(lower(source), 'src1') ORDER BY score DESC, doc_id LIMIT 20)
  UNION ALL SELECT 'relationship', doc_id, score FROM rel UNION ALL SELECT 'timeline', doc_id, score FROM (SELECT doc_id, exp(-(doc_id % 400) / 90) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20)),
x AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, doc_id) AS rk FROM h),
u AS (SELECT doc_id, sum(CASE mode WHEN 'semantic' THEN 0.35 WHEN 'keyword' THEN 0.25 WHEN 'metadata' THEN 0.2 ELSE 0.1 END / (60 + rk)) AS raw, count(*) AS n_modes FROM x GROUP BY doc_id)
SELECT doc_id, round(raw / max(raw) OVER (), 4) AS score, n_modes FROM u"""
)
def five_mode_fusion(spark, sf):
    d = spread(table(spark, sf, "documents")).select("doc_id", "text", "lang", "source")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    at = F.timestamp_seconds(F.unix_timestamp(now().cast("timestamp")) - (F.col("doc_id") % 400) * 86400).cast("timestamp_ntz")
    chunks = d.join(e, "doc_id", "left").withColumn("ts", at)
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    links = d.select(F.col("doc_id").alias("source"), (F.col("doc_id") * 3 + 1).alias("target"))
    modes = C.PLANS["company"][1]
    return A.hybrid(chunks, _TERMS, _VECTOR, {"lang": "en", "source": "src1"}, seeds, links, now(), 20, modes, "doc_id").withColumn("score", F.round("score", 4))


_IMP = "least(1.0, (2 * ({0}) + ({1})) / 28.0)".format(" + ".join(f"contains(t, '{w}')::INT" for w in C.HIGH_IMPORTANCE), " + ".join(f"contains(t, '{w}')::INT" for w in C.MEDIUM_IMPORTANCE))
_CLASSES = ("company", "risk", "commitment")


@q(
    f"""WITH r AS (SELECT doc_id, lang, lower(text) AS t, (doc_id % 100) / 100.0 AS relevance, doc_id % 400 AS age, source FROM documents),
f AS (SELECT doc_id, relevance, exp(-age * ln(2) / 90) AS fresh, CASE WHEN lang = 'en' THEN 0.8 ELSE 0.65 END AS auth, {_IMP} AS imp, CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN contains(source, 'src1') THEN 0.7 ELSE 0.2 END AS rel FROM r),
w(category, a, b, c, d, e) AS (VALUES ('company', 0.35, 0.30, 0.15, 0.15, 0.05), ('risk', 0.25, 0.25, 0.10, 0.30, 0.10), ('commitment', 0.25, 0.20, 0.10, 0.20, 0.25)),
s AS (SELECT category, doc_id, round((a * relevance + b * fresh + c * auth + d * imp + e * rel)::DOUBLE, 4) AS final FROM f, w),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY final DESC, doc_id) AS i FROM s WHERE final >= 0.3)
SELECT category, doc_id, final FROM k WHERE i <= 10"""
)
def ranked_by_class(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    linked = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("src1"))).otherwise(F.array().cast("array<string>"))
    rows = d.select("doc_id", "text", ((F.col("doc_id") % 100) / 100.0).alias("relevance"), (F.col("doc_id") % 400).alias("age_days"), F.when(F.col("lang") == "en", "email").otherwise("document").alias("source_type"), linked.alias("relationships"), F.col("source").alias("about"))
    best = A.ranked_by(rows, "doc_id", list(_CLASSES), ["src1"], 0.3)
    return V.section_top(best, "category", 10, "final", "doc_id").drop("rank")


@q(
    S.CHUNKS.dealt(
        "question_id long; strategy string; section int; title string; content string; source_ids array<string>",
        [
            (1, 'company_360', 0, 'Company Overview', 'Acme makes smart meters.', ['k1']),
            (1, 'company_360', 1, 'Recent Communications', '[May 12, 2024] MEETING: The committee rejected the earlier plan for the smart meters.\n[May 11, 2024] EMAIL: The budget for the smart meters was approved on Monday.\n[May 10, 2024] EMAIL: The budget for the smart meters was approved on Monday. Please share the plan with Jane Doe.', ['k3', 'k6', 'k2']),
            (1, 'company_360', 3, 'Open Commitments', '• [May 11, 2024] Deliver the rollout schedule by Friday.', ['k4']),
            (1, 'company_360', 4, 'Risks & Concerns', '⚠ Vendor delay may move the launch.', ['k5']),
            (2, 'risk_register', 0, 'Active Risks', '⚠ [May 01, 2024] Supplier is unresponsive.\n⚠ [unknown date] Licence may lapse.', ['k8', 'k7']),
            (2, 'risk_register', 3, 'Escalations', '[May 02, 2024] Please escalate now.', ['k9']),
            (3, 'commitment_tracker', 1, 'Source Conversations', '[May 03, 2024] We agreed on the plan.', ['k11']),
            (3, 'commitment_tracker', 2, 'Deadlines', '[May 30, 2024] Deadline of phase one.', ['k12']),
            (4, 'general_summary', 0, 'Relevant Memory', '[May 05, 2024] EMAIL: Short one.\n[May 04, 2024] DOCUMENT: AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA …', ['k15', 'k14']),
        ],
    )
)
def assembled_context(spark, sf):
    return A.assemble(S.CHUNKS.over(spark, sf)).select("question_id", "strategy", "section", "title", "content", "source_ids")


@q(
    S.CHUNKS.dealt(
        "question_id long; title string; priority int; tokens long; share long; decision string; final_tokens long",
        [
            (1, 'Company Overview', 0, 6, 60, 'include_full', 6),
            (1, 'Open Commitments', 2, 14, 0, 'include_summary', 3),
            (1, 'Recent Communications', 3, 69, 0, 'include_summary', 3),
            (1, 'Risks & Concerns', 1, 8, 0, 'include_summary', 3),
            (2, 'Active Risks', 1, 19, 60, 'include_full', 19),
            (2, 'Escalations', 6, 8, 0, 'include_summary', 3),
            (3, 'Deadlines', 6, 9, 0, 'include_summary', 3),
            (3, 'Source Conversations', 6, 9, 60, 'include_full', 9),
            (4, 'Relevant Memory', 7, 77, 60, 'include_summary', 63),
        ],
    )
)
def managed_context(spark, sf):
    sections = A.assemble(S.CHUNKS.over(spark, sf))
    return A.fit_context(sections, F.lit(60)).select("question_id", "title", "priority", "tokens", "share", "decision", "final_tokens")


@q("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, greatest(2000, least(6700, n * 900))::BIGINT AS budget FROM c")
def adaptive_budgets(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", "n", A.adaptive_budget(F.col("n")).alias("budget"))


@q(
    S.CHUNKS.dealt(
        "question_id long; pos int; statement string; cited array<string>; readable string; uncertain boolean; coverage double",
        [
            (1, 0, 'The budget was approved on Monday.', ['k2', 'k6', 'k3'], 'The budget was approved on Monday. [Email · May 10, 2024 · John Roe, Jane Doe] [Email · May 11, 2024] [Meeting · May 12, 2024]', False, 0.666667),
            (1, 1, 'Vendor delay may move the launch.', ['k5', 'k2', 'k3'], 'Vendor delay may move the launch. [Risk · May 09, 2024] [Email · May 10, 2024 · John Roe, Jane Doe] [Meeting · May 12, 2024]', False, 0.666667),
            (1, 2, 'Quantum llamas juggle quietly.', [], 'Quantum llamas juggle quietly.', True, 0.666667),
            (2, 0, 'The licence may lapse.', ['k7'], 'The licence may lapse. [Risk · Unknown date]', False, 1.0),
        ],
    )
)
def cited_answers(spark, sf):
    pool = A.citations(S.CHUNKS.over(spark, sf))
    return A.cite(S.ANSWERS.over(spark, sf, ids=S.CHUNKS.ids), pool).select("question_id", "pos", "statement", "cited", "readable", "uncertain", F.round("coverage", 6).alias("coverage"))


@q(
    S.CHUNKS.dealt(
        "question_id long; chunk_ids array<string>; topic string; text string; tags array<string>; conflicts int[]; confidence double; period string",
        [
            (1, ['k1', 'k2', 'k3', 'k6'], 'Project: Meters', 'Acme makes smart meters. The budget for the smart meters was approved on Monday. Please share the plan with Jane Doe. The committee rejected the earlier plan for the smart meters.', ['budget', 'plan'], [0], 0.9, 'May 10, 2024 – May 12, 2024'),
        ],
    )
)
def fused_memories(spark, sf):
    found = M.fuse(S.CHUNKS.over(spark, sf))
    return found.select("question_id", "chunk_ids", "topic", "text", "tags", "conflicts", "confidence", M.date_range(F.col("first_at"), F.col("last_at")).alias("period"))
