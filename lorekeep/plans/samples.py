"""An organisation's memory made from the driver's tables, and small built-in tables of it. The invented prose of the driver's tables
holds no word of the rule banks, so what is said in them is taken in turn from a few sentences, before the driver's own text."""

from __future__ import annotations

from .base import Derived, Literal

NOW = "2024-05-15 12:00:00"

SAMPLE_MESSAGES = Literal("messages", "msg_id long; company string; sent_at timestamp; text string", [
    (1, "Acme", "2024-05-01 09:00:00", "I'll send the revised proposal by friday."),
    (2, "Acme", "2024-05-02 10:00:00", "We need approval for the budget before 6/1/2024."),
    (3, "Borealis", "2024-05-03 08:30:00", "Let's schedule a call next week to discuss the rollout."),
    (4, "Borealis", "2024-05-04 11:00:00", "We are waiting for regulator feedback, no response from regulator so far."),
    (5, None, "2024-05-05 12:00:00", "I will get back to you tomorrow and confirm the numbers."),
    (6, "Acme", "2024-05-06 13:00:00", "The weather was fine and nothing happened."),
    (7, "Cedar", "2024-05-07 14:00:00", "The contract will be ready within 3 days and we will deliver it in 2 weeks."),
    (8, "Cedar", "2024-05-08 15:00:00", "Checking this by end of month."),
    (9, "Acme", "2024-05-09 16:00:00", "Send."),
])

DEADLINES = Literal("phrases", "id long; text string", [
    (1, "Please finish by Friday"), (2, "due by end of day"), (3, "deliver by end of week"), (4, "ready by end of month"), (5, "by end of quarter at the latest"), (6, "before 6/1/2024 please"),
    (7, "by 25-12-24"), (8, "next week works"), (9, "this week then"), (10, "within 3 days"), (11, "in 2 weeks"), (12, "in 30 hours"), (13, "tomorrow"), (14, "today"), (15, "see you monday"),
    (16, "next month"), (17, "this wednesday"), (18, "no date at all"), (19, ""), (20, None), (21, "by 31/31/2024"),
])

SAMPLE_COMMITMENTS = Literal("commitments", "commitment_id string; company string; commitment_type string; status string; due timestamp; owner string; updated_at timestamp; text string", [
    ("c1", "Acme", "deliverable", "open", "2024-05-20 12:00:00", "Jane Doe", "2024-05-01 09:00:00", "Send the revised proposal for the board"),
    ("c2", "Acme", "approval", "overdue", "2024-05-10 12:00:00", "John Roe", "2024-05-02 09:00:00", "Approve the budget for the smart meters"),
    ("c3", "Borealis", "meeting", "in_progress", None, None, "2024-05-03 09:00:00", "Schedule the rollout review call"),
    ("c4", "Borealis Regulator", "external_dependency", "overdue", "2024-05-01 12:00:00", "Jane Doe", "2024-05-02 09:00:00", "Regulator must confirm the licence"),
    ("c5", "Cedar", "external_dependency", "overdue", "2024-05-05 12:00:00", None, "2024-05-06 09:00:00", "Vendor delivers the spare parts"),
    ("c6", "Cedar", "external_dependency", "overdue", "2024-05-06 12:00:00", None, "2024-05-06 09:00:00", "Vendor delivers the cables"),
    ("c7", "Cedar", "external_dependency", "overdue", "2024-05-07 12:00:00", None, "2024-05-06 09:00:00", "Vendor delivers the racks"),
    ("c8", "Delta", "deliverable", "resolved", "2024-05-08 12:00:00", "Jane Doe", "2024-05-08 09:00:00", "Share the $5 million deal summary"),
    ("c9", None, "response", "open", "2024-05-16 10:00:00", "John Roe", "2024-05-14 09:00:00", "Confirm the $5 million payment to the key client with the ceo"),
])

SAMPLE_FOLLOWUPS = Literal("followups", "sid long; company string; text string", [
    (1, "Acme", "Any update on the revised proposal for the board?"),
    (2, "Acme", "We have sent over the revised proposal for the board."),
    (3, "Acme", "Any news about the revised proposal for the board?"),
    (4, "Borealis", "The rollout review call is not done, reminder to schedule."),
    (5, None, "Payment of the million confirmed with the client, confirm please."),
    (6, "Cedar", "Completely unrelated sentence that was delivered."),
    (7, "Acme", "sent"),
])

SAMPLE_COMPANIES = Literal("companies", "company string; kind string; health string; health_score double; silence_days long; response_hours double; impact string; rank string", [
    ("Acme", "partner", "at_risk", 0.2, 20, 30.0, "high", "high"), ("Borealis", "regulator", "attention_required", 0.4, 10, 100.0, "medium", "medium"), ("Cedar", "vendor", "healthy", 0.9, 2, 150.0, "low", "low"),
    ("Delta", "investor", "at_risk", 0.1, 40, None, None, None), ("Elm", "partner", "attention_required", 0.3, 3, 72.0, "low", "low"),
])

SAMPLE_ESCALATIONS = Literal("escalations", "escalation_id string; company string; signal_type string; title string; severity string; is_active boolean", [
    ("e1", "Acme", "long_silence", "Silence at Acme", "high", True), ("e2", "Acme", "deadline_passed", "Overdue at Acme", "critical", True), ("e3", "Acme", "negative_pattern", "Tone at Acme", "medium", True),
    ("e4", "Cedar", "deadline_passed", "Overdue at Cedar", "low", True), ("e5", "Cedar", "project_drift", "Drift at Cedar", "high", False), ("e6", None, "project_drift", "Drift", "medium", True),
    ("e7", "Delta", "long_silence", "Silence at Delta", "medium", True), ("e8", "Delta", "repeated_followup", "Chasing Delta", "medium", True),
])

SAMPLE_RISKS = Literal("risks", "risk_id string; company string; title string; category string; severity string; risk_score double; first_at timestamp; evaluated_at timestamp; is_active boolean", [
    ("r1", "Acme", "SLA breach", "vendor", "critical", 0.9, "2024-05-15 08:00:00", "2024-05-15 09:00:00", True), ("r2", "Acme", "Approval pending", "approval", "medium", 0.5, "2024-05-14 08:00:00", "2024-05-15 09:00:00", True),
    ("r3", None, "Regulatory attention", "regulatory", "high", 0.7, "2024-05-14 20:00:00", "2024-05-15 10:00:00", True), ("r4", "Cedar", "Old crisis", "contract", "critical", 0.8, "2024-01-01 08:00:00", "2024-05-01 09:00:00", True),
    ("r5", "Cedar", "Closed risk", "contract", "critical", 0.95, "2024-05-15 08:00:00", "2024-05-15 09:00:00", False), ("r6", "Borealis", "Watch item", "deployment", "low", 0.1, "2024-03-01 08:00:00", "2024-05-01 09:00:00", True),
])

SAMPLE_INTERACTIONS = Literal("interactions", "interaction_id string; company string; occurred_at timestamp; subject string; summary string", [
    ("i1", "Acme", "2024-05-14 15:00:00", "Proposal", "Following up on the proposal"), ("i2", "Acme", "2024-05-01 15:00:00", "Reminder", "Please look"), ("i3", "Acme", "2024-03-01 15:00:00", "Reminder", "Long ago"),
    ("i4", "Cedar", "2024-05-15 09:00:00", "Parts", "Any update on parts"), ("i5", "Cedar", "2024-05-15 10:00:00", "Parts", None), ("i6", None, "2024-05-12 09:00:00", "Hello", "Any news"), ("i7", "Borealis", "2024-05-15 11:30:00", "Licence", "Licence review went well"),
])

QUESTIONS = Literal("questions", "question_id long; query string", [
    (1, "Who is John Smith?"), (2, "What is happening with Schneider Electric recently?"), (3, "Status of the Smart Meter project this month"), (4, "What risks exist around Acme last quarter?"), (5, "Which commitments are pending?"), (6, "Good morning"),
])

CHUNKS = Literal("chunks", "question_id long; strategy string; chunk_id string; source_type string; text string; ts timestamp; score double; company string; project string; person string; kind string; tags array<string>; relationships array<string>; people array<string>", [
    (1, "company_360", "k1", "entity", "Acme makes smart meters.", None, 0.9, "Acme", "", "", "", [], [], []),
    (1, "company_360", "k2", "email", "The budget for the smart meters was approved on Monday. Please share the plan with Jane Doe.", "2024-05-10 08:00:00", 0.8, "Acme", "Meters", "", "", ["budget"], ["k3"], ["John Roe"]),
    (1, "company_360", "k3", "meeting", "The committee rejected the earlier plan for the smart meters.", "2024-05-12 08:00:00", 0.7, "ACME", "", "", "", ["plan"], [], []),
    (1, "company_360", "k4", "commitment", "Deliver the rollout schedule by Friday.", "2024-05-11 08:00:00", 0.6, "Borealis", "", "", "", [], [], []),
    (1, "company_360", "k5", "risk", "Vendor delay may move the launch.", "2024-05-09 08:00:00", 0.5, "Cedar", "", "", "", [], [], []),
    (1, "company_360", "k6", "email", "The budget for the smart meters was approved on Monday.", "2024-05-11 08:00:00", 0.4, "acme", "", "", "", ["budget"], [], []),
    (2, "risk_register", "k7", "risk", "Licence may lapse.", None, 0.2, "", "", "Jane Doe", "", [], [], []),
    (2, "risk_register", "k8", "risk", "Supplier is unresponsive.", "2024-05-01 08:00:00", 0.9, "", "", "", "", [], [], []),
    (2, "risk_register", "k9", "email", "Please escalate now.", "2024-05-02 08:00:00", 0.8, "", "", "", "", ["escalat"], [], []),
    (2, "risk_register", "k10", "email", "Nothing special here.", "2024-05-03 08:00:00", 0.7, "", "", "", "", ["other"], [], []),
    (3, "commitment_tracker", "k11", "meeting", "We agreed on the plan.", "2024-05-03 08:00:00", 0.7, "", "", "jane doe", "", [], [], []),
    (3, "commitment_tracker", "k12", "timeline", "Deadline of phase one.", "2024-05-30 08:00:00", 0.6, "", "", "", "deadline", [], [], []),
    (3, "commitment_tracker", "k13", "timeline", "Kick-off.", "2024-04-30 08:00:00", 0.5, "", "", "", "event", [], [], []),
    (4, "unheard_of", "k14", "document", "A" * 300, "2024-05-04 08:00:00", 0.5, "", "", "", "", [], [], []),
    (4, "unheard_of", "k15", "email", "Short one.", "2024-05-05 08:00:00", 0.4, "", "", "", "", [], [], []),
])

ANSWERS = Literal("answers", "question_id long; answer string", [
    (1, "The budget was approved on Monday. Vendor delay may move the launch. Quantum llamas juggle quietly."), (2, "The licence may lapse."), (4, "Hm."),
])


# ------------------------------------------------------------------ made from the driver's tables
def _turn(key: str, *said: str) -> str:
    """One of the strings, in turn."""
    cases = " ".join(f"WHEN {i} THEN {repr(x) if x is not None else 'NULL'}" for i, x in enumerate(said))
    return f"CASE {key} % {len(said)} {cases} END"


def _company(key: str) -> str:
    return f"CASE WHEN {key} % 41 = 0 THEN NULL WHEN {key} % 7 = 0 THEN 'Regulator ' || CAST({key} AS STRING) ELSE 'Company ' || CAST({key} AS STRING) END"


_ASKS = [r[3] for r in SAMPLE_MESSAGES.rows]
_PROMISES = [r[7] for r in SAMPLE_COMMITMENTS.rows]
_CHASES = [r[2] for r in SAMPLE_FOLLOWUPS.rows]

#: Turns of conversations, each beginning with one of the sentences.
MESSAGES = Derived("messages", f"""SELECT conv_id * 1000 + turn AS msg_id, {_company("conv_id")} AS company, {_turn("(conv_id + turn)", *(x.replace("'", "’") for x in _ASKS))} || ' ' || text AS text FROM {{conversations}}""")

#: Orders as commitments of their customers.
COMMITMENTS = Derived("commitments", f"""SELECT 'c' || CAST(o_orderkey AS STRING) AS commitment_id, {_company("o_custkey")} AS company,
  {_turn("o_orderkey", "deliverable", "approval", "meeting", "external_dependency", "external_dependency", "response")} AS commitment_type,
  CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'P' THEN 'overdue' WHEN o_orderkey % 4 = 0 THEN 'in_progress' ELSE 'open' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL '8800' DAY END AS due, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Owner ' || CAST(o_orderkey % 97 AS STRING) END AS owner,
  o_orderdate + INTERVAL '8790' DAY AS updated_at, {_turn("o_orderkey", *_PROMISES)} || ', lot ' || CAST(o_orderkey AS STRING) AS text FROM {{orders}}""")

#: Turns of conversations that chase or confirm what was promised.
FOLLOWUPS = Derived("followups", f"""SELECT conv_id * 1000 + turn AS sid, {_company("conv_id")} AS company, {_turn("(conv_id + turn)", *_CHASES)} AS text FROM {{conversations}}""")

#: Customers as companies.
COMPANIES = Derived("companies", f"""SELECT coalesce({_company("c_custkey")}, 'Company ' || CAST(c_custkey AS STRING)) AS company, CASE c_mktsegment WHEN 'BUILDING' THEN 'partner' WHEN 'MACHINERY' THEN 'vendor' ELSE 'investor' END AS kind,
  CASE WHEN c_acctbal < 0 THEN 'at_risk' WHEN c_acctbal < 3000 THEN 'attention_required' ELSE 'healthy' END AS health, CAST((c_acctbal + 1000) / 11000 AS DOUBLE) AS health_score, c_custkey % 40 AS silence_days,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 150 AS DOUBLE) END AS response_hours, {_turn("c_custkey", "high", "medium", "low", None)} AS impact, {_turn("c_custkey", "low", "high", None, "medium", None)} AS rank FROM {{customer}}""")

#: Orders that were given a priority as escalations.
ESCALATIONS = Derived("escalations", f"""SELECT 'e' || CAST(o_orderkey AS STRING) AS escalation_id, {_company("o_custkey")} AS company, {_turn("o_orderkey", "long_silence", "deadline_passed", "negative_pattern", "project_drift", "repeated_followup")} AS signal_type,
  'Escalation of lot ' || CAST(o_orderkey AS STRING) AS title, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END AS severity, o_orderstatus <> 'F' AS is_active FROM {{orders}}""")

#: Events as risks.
RISKS = Derived("risks", f"""SELECT 'r' || CAST(event_id AS STRING) AS risk_id, {_company("user_id")} AS company, {_turn("event_id", "SLA breach", "Approval pending", "Regulatory attention", "Old crisis", "Watch item")} || ' ' || CAST(event_id AS STRING) AS title, {_turn("event_id", "vendor", "approval", "regulatory", "contract", "deployment")} AS category,
  {_turn("event_id", "critical", "high", "medium", "low")} AS severity, CAST(event_id % 100 AS DOUBLE) / 100 AS risk_score, ts + INTERVAL '106' DAY AS first_at, ts + INTERVAL '107' DAY AS evaluated_at, event_type <> 'view' AS is_active FROM {{events}}""")

#: Events as interactions.
INTERACTIONS = Derived("interactions", f"""SELECT 'i' || CAST(event_id AS STRING) AS interaction_id, {_company("user_id")} AS company, ts + INTERVAL '106' DAY AS occurred_at, {_turn("event_id", "Proposal", "Reminder", "Parts", "Hello", "Licence")} AS subject,
  {_turn("event_id", "Following up on the proposal", "Please look", "Any update on parts", None, "All went well", "Any news", "Thanks")} AS summary FROM {{events}}""")

#: Orders as projects with what is open there.
PROJECTS = Derived("projects", """SELECT 'P' || CAST(o_orderkey AS STRING) AS project, o_orderdate + INTERVAL '8800' DAY AS due, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 9 = 0 THEN 'cancelled' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS critical_risks, o_orderkey % 4 AS overdue_commitments, o_orderkey % 6 AS active_risks, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS health_score FROM {orders}""")

#: Events as what was said.
TALK = Derived("talk", f"""SELECT {_company("user_id")} AS company, ts + INTERVAL '106' DAY AS said_at, {_turn("event_id", "a delay again", "this issue is serious", "all fine", "we are blocked", "see you there")} AS text FROM {{events}}""")

#: Documents and their beginnings.
TEXTS = Derived("texts", "SELECT doc_id AS id, text AS a, substr(text, 30, 400) AS b FROM {documents}")

#: Documents, each beginning with a sentence of what has happened.
NEWS = Derived("news", f"""SELECT doc_id, {_turn("doc_id", "The contract was signed.", "Proposal sent on Monday.", "We need approval here.", "Approval delayed again.", "The board approved it.", "They agreed to help.", "A risk identified today.", "It was decided.", "A meeting took place.", "The report prepared by Ann.", "Kick-off in May.", "A milestone.", "The project completed.", "Hello.")} || ' ' || text AS text FROM {{documents}}""")
