"""All registered queries of the library and their SQL twins, on the driver's tables.

Stand-ins: documents are chunks (source is the source type, lang metadata), embeddings the vectors,
conversations the threads, events the interactions, orders the commitments (due: o_orderdate),
customers and suppliers the companies, lineitem the observed relationships. Pattern banks are
parameters; on this invented prose they are words that occur in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import detectors as D
from ..operators import entities as E
from ..operators import extraction as T
from ..operators import graph as G
from ..operators import retrieval as V
from .. import constants as C
from . import samples as S
from .base import EXAMPLE_SQL, EXAMPLES, ORACLE, QUERIES, example, expected  # noqa: F401
from .base import q as _q
from .base import quoted
from .base import spread as _spread
from .base import table as _t

# ------------------------------------------------------------------ retrieval
TERMS = ["the", "tion", "there", "der", "que"]
_SQL_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z0-9]+$'))"
_SQL_BM25 = f"""
t AS (SELECT doc_id, {_SQL_TOKENS} AS toks FROM documents),
l AS (SELECT doc_id, len(toks) AS n, toks FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS avg_n FROM l),
q AS (SELECT unnest({TERMS!r}) AS term),
f AS (SELECT doc_id, n, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM l, q),
g AS (SELECT * FROM f WHERE tf > 0),
d AS (SELECT term, count(*) AS df FROM g GROUP BY term),
r AS (SELECT doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_n))) AS raw
      FROM g JOIN d USING (term), s GROUP BY doc_id),
k AS (SELECT doc_id, raw / max(raw) OVER () AS score FROM r)"""


@_q(f"WITH {_SQL_BM25} SELECT doc_id, round(score, 9) AS score FROM k ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    return V.bm25(_spread(_t(spark, sf, "documents")), TERMS, 10, "doc_id", "text").withColumn("score", F.round("score", 9))


QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_SQL_COS = f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, {QUERY_VECTOR!r}::DOUBLE[] AS q FROM embeddings),
c AS (SELECT vec_id, label, greatest(0, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))) AS score FROM v)"""


@_q(f"WITH {_SQL_COS} SELECT vec_id, round(score, 9) AS score FROM c ORDER BY c.score DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf):
    return V.top(V.vector_search(_t(spark, sf, "embeddings"), QUERY_VECTOR, "vec_id", "embedding"), 20, "vec_id").withColumn("score", F.round("score", 9))


@_q(f"WITH {_SQL_COS} SELECT vec_id, round(score, 9) AS score FROM c WHERE label IN (1, 2) AND score >= 0.1 ORDER BY c.score DESC, vec_id LIMIT 20")
def filtered_cosine_topk(spark, sf):
    found = V.vector_search(_t(spark, sf, "embeddings"), QUERY_VECTOR, "vec_id", "embedding", 0.1, F.col("label").isin(1, 2))
    return V.top(found, 20, "vec_id").withColumn("score", F.round("score", 9))


@_q("SELECT doc_id, ((lang = 'en')::INT + contains(lower(source), 'src1')::INT) / 2.0::DOUBLE AS score FROM documents WHERE lang = 'en' OR contains(lower(source), 'src1')")
def metadata_search(spark, sf):
    return V.metadata_search(_t(spark, sf, "documents").select("doc_id", "lang", "source"), {"lang": "en", "source": "src1"}, "doc_id")


AS_OF = "2024-01-31 00:00:00"


@_q(f"SELECT event_id, round(exp(-floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) / 90), 9) AS score FROM events WHERE floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) <= 14")
def timeline_search(spark, sf):
    e = _t(spark, sf, "events")
    return V.timeline_search(e, F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz"), "event_id", 14).withColumn("score", F.round("score", 9))


@_q(
    f"""WITH {_SQL_BM25},
h AS (
  SELECT 'keyword' AS mode, doc_id, score FROM (SELECT * FROM k ORDER BY score DESC, doc_id LIMIT 50)
  UNION ALL SELECT 'metadata', doc_id, score FROM (
    SELECT doc_id, ((lang = 'en')::INT + (source = 'src1')::INT) / 2.0 AS score FROM documents WHERE lang = 'en' OR source = 'src1' ORDER BY score DESC, doc_id LIMIT 50)),
x AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, doc_id) AS rk FROM h),
u AS (SELECT doc_id, sum(CASE mode WHEN 'keyword' THEN 0.25 ELSE 0.2 END / (60 + rk)) AS raw, count(*) AS n_modes FROM x GROUP BY doc_id)
SELECT doc_id, round(raw / max(raw) OVER (), 4) AS score, n_modes FROM u"""
)
def hybrid_fusion(spark, sf):
    d = _t(spark, sf, "documents")
    keyword = V.bm25(_spread(d), TERMS, 50, "doc_id", "text").withColumn("mode", F.lit("keyword"))
    score = ((F.col("lang") == "en").cast("int") + (F.col("source") == "src1").cast("int")) / 2
    meta = V.top(d.select("doc_id", score.alias("score")).where("score > 0"), 50, "doc_id").withColumn("mode", F.lit("metadata"))
    return V.rank_fusion(keyword.unionByName(meta), "doc_id").withColumn("score", F.round("score", 4))


@_q(
    """WITH r AS (SELECT doc_id, lang, source, text, (doc_id % 100) / 100.0 AS relevance, doc_id % 400 AS age FROM documents),
f AS (SELECT doc_id, 0.35 * relevance + 0.30 * exp(-age * ln(2) / 90) + 0.15 * CASE WHEN lang = 'en' THEN 0.8 ELSE 0.65 END
  + 0.15 * least(1.0, (2 * (contains(lower(text), 'board')::INT + contains(lower(text), 'ceo')::INT + contains(lower(text), 'risk')::INT + contains(lower(text), 'signed')::INT
      + contains(lower(text), 'urgent')::INT + contains(lower(text), 'critical')::INT + contains(lower(text), 'escalat')::INT + contains(lower(text), 'deadline')::INT + contains(lower(text), 'overdue')::INT
      + contains(lower(text), 'blocked')::INT + contains(lower(text), 'investor')::INT + contains(lower(text), 'regulator')::INT + contains(lower(text), 'compliance')::INT + contains(lower(text), 'contract')::INT)
    + contains(lower(text), 'follow-up')::INT + contains(lower(text), 'commitment')::INT + contains(lower(text), 'project')::INT + contains(lower(text), 'client')::INT
      + contains(lower(text), 'pending')::INT + contains(lower(text), 'approval')::INT + contains(lower(text), 'budget')::INT + contains(lower(text), 'milestone')::INT) / 28.0)
  + 0.05 * 0.5 AS final FROM r)
SELECT doc_id, round(final, 9) AS final FROM f ORDER BY round(final, 9) DESC, doc_id LIMIT 25"""
)
def ranked_results(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text", ((F.col("doc_id") % 100) / 100.0).alias("relevance"), (F.col("doc_id") % 400).alias("age_days"), F.when(F.col("lang") == "en", "email").otherwise("document").alias("source_type"), F.lit(None).cast("double").alias("relationship"))
    return V.top(V.rank(d).select("doc_id", F.round("final", 9).alias("final")), 25, "doc_id", "final")


@_q("SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 3")
def section_top(spark, sf):
    return V.section_top(_t(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", 3, "n_chars", "doc_id")


@_q(
    """WITH RECURSIVE k AS (SELECT source, doc_id, floor(length(text) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, tokens, i, CASE WHEN least(tokens, 250) <= 1500 THEN least(tokens, 250) ELSE 0 END AS used, least(tokens, 250) <= 1500 AS fits FROM k WHERE i = 1
  UNION ALL SELECT k.source, k.doc_id, k.tokens, k.i, r.used + CASE WHEN r.used + least(k.tokens, 250) <= 1500 THEN least(k.tokens, 250) ELSE 0 END, r.used + least(k.tokens, 250) <= 1500
  FROM r JOIN k ON k.source = r.source AND k.i = r.i + 1 WHERE k.i <= 20)
SELECT source, doc_id, tokens, CASE WHEN NOT fits THEN 'exclude' WHEN tokens <= 250 THEN 'include' ELSE 'summarise' END AS decision, CASE WHEN fits THEN least(tokens, 250) ELSE 0 END AS final_tokens FROM r"""
)
def context_budget(spark, sf):
    d = _t(spark, sf, "documents").select("source", "doc_id", "text", (-F.col("doc_id")).alias("score"))
    best = V.section_top(d, "source", 20, "score", "doc_id")
    return V.fit_budget(best, "source", "rank", "text", 1500, F.lit(250)).select("source", "doc_id", "tokens", "decision", "final_tokens")


@_q(
    r"""WITH a AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4))) AS w FROM benchmark),
b AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4))) AS w FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s)
SELECT item_id AS statement_id, doc_id AS chunk_id, shared, rank::INT AS rank FROM r WHERE rank <= 3"""
)
def token_overlap_top3(spark, sf):
    s = _t(spark, sf, "benchmark").select(F.col("item_id").alias("statement_id"), "text")
    return V.attribute(s, _spread(_t(spark, sf, "documents")).select(F.col("doc_id").alias("chunk_id"), "text"))


# ------------------------------------------------------------------ text
@_q(
    r"""SELECT doc_id, len(regexp_split_to_array(trim(text), '\s+'))::INT AS word_count,
len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) > 0 AS has_email,
len(regexp_extract_all(text, 'https?://[^\s\)\]\>"'']+')) > 0 AS has_url,
len(regexp_extract_all(text, '(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}')) > 0 AS has_phone
FROM documents WHERE length(text) >= 10"""
)
def enrich_flags(spark, sf):
    e = T.enrich(_spread(_t(spark, sf, "documents")).select("doc_id", "text"))
    return e.select("doc_id", "word_count", (F.size("emails") > 0).alias("has_email"), (F.size("urls") > 0).alias("has_url"), (F.size("phones") > 0).alias("has_phone"))


@_q(
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
x AS (SELECT doc_id, unnest(p) AS sentence FROM s)
SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest FROM x WHERE length(sentence) >= 10 GROUP BY doc_id"""
)
def sentence_counts(spark, sf):
    s = T.explode_sentences(_t(spark, sf, "documents"), "doc_id")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("sentence")).cast("long").alias("longest"))


@_q(
    r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(text) <> ''),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 700)) AS st FROM w)
SELECT doc_id, (st / 700)::INT AS chunk_index, len(w[st + 1 : st + 800])::INT AS n_words, md5(array_to_string(w[st + 1 : st + 800], ' ')) AS content_hash FROM s"""
)
def chunk_sliding_window(spark, sf):
    return T.word_windows(_t(spark, sf, "documents"), "doc_id").select("doc_id", "chunk_index", "n_words", F.md5("content").alias("content_hash"))


@_q(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_html(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@_q(r"SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_host_counts(spark, sf):
    return _t(spark, sf, "pages").groupBy(F.regexp_extract("url", "https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@_q("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_docs(spark, sf):
    d = _t(spark, sf, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash"))
    return d.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _sql_hits(patterns: list[str], text: str = "t") -> str:
    return " + ".join(f"regexp_matches({text}, {quoted(p)})::INT" for p in patterns)


@_q(
    f"""WITH {S.MESSAGES.cte}, n AS (SELECT msg_id, {", ".join(f"{_sql_hits(ps)} AS {k}" for k, ps in C.COMMITMENT_PATTERNS.items())} FROM (SELECT msg_id, lower(text) AS t FROM messages)),
g AS (SELECT *, {" + ".join(C.COMMITMENT_PATTERNS)} AS n_patterns, greatest({", ".join(C.COMMITMENT_PATTERNS)}) AS most FROM n)
SELECT msg_id, CASE {" ".join(f"WHEN {k} = most THEN '{k}'" for k in C.COMMITMENT_PATTERNS)} END AS kind, n_patterns FROM g WHERE n_patterns > 0"""
)
def commitment_types(spark, sf):
    """The kind of promise of which a turn holds most signs, by the full bank."""
    t = F.lower(F.col("text"))
    rows = S.MESSAGES.frame(spark, sf).select("msg_id", X.most_hits(t, C.COMMITMENT_PATTERNS).alias("kind"), X.hits(t, [p for b in C.COMMITMENT_PATTERNS.values() for p in b]).alias("n_patterns"))
    return rows.where("n_patterns > 0")


@_q(
    f"""WITH {S.NEWS.cte} SELECT doc_id, CASE {" ".join(f"WHEN {_sql_hits(ps)} > 0 THEN '{k}'" for k, ps in C.EVENT_PATTERNS.items() if ps)} ELSE 'email_sent' END AS event_type FROM (SELECT doc_id, lower(text) AS t FROM news)"""
)
def event_types(spark, sf):
    """What each document says has happened, by the full bank."""
    return T.events_of(S.NEWS.frame(spark, sf), "text").select("doc_id", "event_type")


#: Rows of a nation's suppliers (by name) that a customer's name meets at once, rows of one name that are kept together, and parts of a
#: nation's customers.
NAMES_AT_ONCE, ROWS_AT_ONCE, PARTS = 128, 128, 16


@_q()
def fuzzy_customer_pairs(spark, sf):
    """Names of all customers and suppliers that share a nation; a nation's different names are scored once, blocks of suppliers' names
    with many customers' at once. Names carry the keys of their rows, so no pair is shuffled: pairs leave the join that made them."""
    name = lambda c: F.coalesce(X.normalise_name(F.col(c)), F.lit(""))
    nth = lambda *part, by: F.row_number().over(Window.partitionBy(*part).orderBy(*by)) - 1
    c = _spread(_t(spark, sf, "customer")).where("c_nationkey is not null").select("c_custkey", F.col("c_nationkey").alias("_n"), name("c_name").alias("a"))
    s = _spread(_t(spark, sf, "supplier")).where("s_nationkey is not null").select("s_suppkey", F.col("s_nationkey").alias("_n"), name("s_name").alias("b"))
    c = c.withColumn("_k", F.floor(nth("_n", "a", by=["c_custkey"]) / ROWS_AT_ONCE)).groupBy("_n", "a", "_k").agg(F.collect_list("c_custkey").alias("_c")).drop("_k")
    s = s.withColumn("_k", F.floor(nth("_n", by=["b", "s_suppkey"]) / NAMES_AT_ONCE)).groupBy("_n", "_k", "b").agg(F.collect_list("s_suppkey").alias("_s"))
    s = s.groupBy("_n", "_k").agg(F.array_sort(F.collect_list(F.struct("b", "_s"))).alias("_b"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    blocks = s.select("_n", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_p"), F.col("_b.b").alias("b"), F.col("_b._s").alias("_s")).repartition(tasks, "_n", "_p")
    c = c.withColumn("_p", F.pmod(F.xxhash64("a", F.col("_c")[0]), F.lit(PARTS)).cast("int")).repartition(tasks, "_n", "_p")
    pairs = blocks.join(c.hint("merge"), ["_n", "_p"])  # for each block all its customers, one after another
    scored = E.with_name_score(pairs.select("a", "b", "_c", "_s"), "a", "b")
    rows = scored.select(F.explode("_c").alias("c_custkey"), "_s", "name_score").select("c_custkey", "_s", F.posexplode("name_score").alias("_i", "_score"))
    return rows.select("c_custkey", F.explode(F.col("_s")[F.col("_i")]).alias("s_suppkey"), _to_millionths(F.col("_score")).alias("name_score"))


def _to_millionths(x):
    """round(x, 6) of numbers from 0 to 1; decimals are made only near the half where binary fractions might fall on the wrong side."""
    part = x * 1e6 - F.floor(x * 1e6)
    return F.when(F.abs(part - 0.5) > 1e-6, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(F.round(x, 6))


@example(
    expected(
        "query string; category string; intent string; temporal string; entities array<string>",
        [
            ("What is pending with KEI?", "commitment", "pending", "all_time", ["KEI"]), ("What commitments remain unresolved?", "commitment", "pending", "all_time", []), ("What risks exist around deployment?", "project", "risk_scan", "all_time", []),
            ("Summarize investor discussions.", "general", "summary", "all_time", []), ("Who is John Smith?", "person", "identification", "all_time", ["John Smith"]), ("Status of Smart Meter Rollout?", "project", "status", "all_time", ["Smart Meter Rollout"]),
        ],
    )
)
def classified_questions(spark, sf):
    rows = ["What is pending with KEI?", "What commitments remain unresolved?", "What risks exist around deployment?", "Summarize investor discussions.", "Who is John Smith?", "Status of Smart Meter Rollout?"]
    return T.classify_queries(spark.createDataFrame([(q,) for q in rows], "query string"))


# ------------------------------------------------------------------ relational core
_STATUS = {"P": "open", "O": "in_progress", "F": "resolved"}
DUE_AS_OF = "1998-01-01 00:00:00"


def _commitments(spark, sf):
    o = _t(spark, sf, "orders")
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("o_orderstatus")]
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("due"), F.col("o_totalprice").alias("value"), "o_orderpriority")


_SQL_COMMIT = f"""c AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'P' THEN 'open' WHEN 'O' THEN 'in_progress' ELSE 'resolved' END AS status,
  o_orderdate AS due, o_totalprice AS value, o_orderpriority FROM orders),
m AS (SELECT *, CASE WHEN status IN ('open', 'in_progress') AND due < TIMESTAMP '{DUE_AS_OF}' THEN 'overdue' ELSE status END AS status_now,
  CASE WHEN status IN ('open', 'in_progress') AND due < TIMESTAMP '{DUE_AS_OF}' THEN date_diff('day', due::DATE, DATE '1998-01-01') ELSE 0 END AS days_overdue FROM c)"""


def _overdue(spark, sf):
    return D.mark_overdue(_commitments(spark, sf), "status", "due", F.lit(DUE_AS_OF).cast("timestamp_ntz"))


@_q(f"WITH {_SQL_COMMIT} SELECT id, status_now, days_overdue::INT AS days_overdue FROM m")
def mark_overdue(spark, sf):
    return _overdue(spark, sf).select("id", "status_now", "days_overdue")


@_q(f"WITH {_SQL_COMMIT}, s AS (SELECT unnest(['open', 'in_progress', 'resolved', 'overdue', 'cancelled']) AS status_now) SELECT s.status_now, count(m.id) AS n FROM s LEFT JOIN m USING (status_now) GROUP BY 1")
def status_dashboard(spark, sf):
    domain = spark.createDataFrame([(s,) for s in ("open", "in_progress", "resolved", "overdue", "cancelled")], "status_now string")
    counts = _overdue(spark, sf).groupBy("status_now").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, "status_now", "left").select("status_now", F.coalesce("n", F.lit(0)).alias("n"))


@_q(f"WITH {_SQL_COMMIT} SELECT coalesce(owner::VARCHAR, 'Unknown') AS owner, count(*) AS n_overdue, max(days_overdue)::INT AS max_days FROM m WHERE status_now = 'overdue' GROUP BY 1")
def overdue_by_owner(spark, sf):
    return D.overdue_by(_overdue(spark, sf), "owner")


_SQL_URG = "CASE WHEN d < 0 THEN 1.0 WHEN d <= 0 THEN 0.95 WHEN d <= 1 THEN 0.9 WHEN d <= 3 THEN 0.8 WHEN d <= 7 THEN 0.7 WHEN d <= 14 THEN 0.55 WHEN d <= 30 THEN 0.35 ELSE 0.15 END"


@_q(f"SELECT o_orderkey AS id, d AS days_left, ({_SQL_URG})::DOUBLE AS urgency FROM (SELECT o_orderkey, floor((epoch(o_orderdate) - epoch(TIMESTAMP '{DUE_AS_OF}')) / 86400)::BIGINT AS d FROM orders)")
def deadline_urgency(spark, sf):
    c = _commitments(spark, sf).withColumn("days_left", X.days_between(F.col("due"), F.lit(DUE_AS_OF).cast("timestamp_ntz")))
    return c.select("id", "days_left", X.urgency(F.col("days_left")).cast("double").alias("urgency"))


@_q(
    f"""WITH f AS (SELECT o_orderkey AS id, floor((epoch(o_orderdate) - epoch(TIMESTAMP '{DUE_AS_OF}')) / 86400)::BIGINT AS d, (o_orderpriority = '1-URGENT')::INT AS ceo,
  CASE WHEN o_totalprice > 300000 THEN 0.9 WHEN o_totalprice > 100000 THEN 0.5 ELSE 0.2 END AS rev FROM orders),
p AS (SELECT id, round(0.25 * ceo + 0.25 * rev + 0.2 * ({_SQL_URG}) + 0.2 * 0 + 0.1 * 0.5, 6)::DOUBLE AS priority_score FROM f)
SELECT id, priority_score, CASE WHEN priority_score >= 0.65 THEN 'HIGH' WHEN priority_score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM p"""
)
def priority_score(spark, sf):
    c = _commitments(spark, sf)
    left = X.days_between(F.col("due"), F.lit(DUE_AS_OF).cast("timestamp_ntz"))
    rows = c.select(
        "id",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("ceo_involvement"),
        F.when(F.col("value") > 300000, 0.9).when(F.col("value") > 100000, 0.5).otherwise(0.2).alias("revenue_impact"),
        X.urgency(left).alias("deadline_urgency"),
        F.lit(0).alias("escalation_level"),
        F.lit(0.5).alias("relationship_importance"),
    )
    scored = D.priority(rows).withColumn("priority_score", F.round("priority_score", 6))
    level = F.when(F.col("priority_score") >= 0.65, "HIGH").when(F.col("priority_score") >= 0.35, "MEDIUM").otherwise("LOW")
    return scored.select("id", "priority_score", level.alias("priority"))


@_q(
    "SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20"
)
def entity_search_paged(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    rows = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000) & F.col("c_name").ilike("%1%"))
    return rows.join(n, rows["c_nationkey"] == n["n_nationkey"]).orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(20).select("c_custkey", "c_name", "n_name", "c_acctbal")


@_q("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphans(spark, sf):
    return E.missing(_t(spark, sf, "customer").select("c_custkey", "c_name"), _t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")


@_q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def attribution_gap(spark, sf):
    return E.missing(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), "doc_id", "doc_id")


@_q("SELECT count(*) AS n_documents, count(l.doc_id) AS n_labelled, round(100.0 * count(l.doc_id) / count(*), 1) AS coverage_pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coverage_stats(spark, sf):
    d, k = _t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))
    out = d.join(k, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_documents"), F.count("has").alias("n_labelled"))
    return out.withColumn("coverage_pct", F.when(F.col("n_documents") > 0, F.round(100.0 * F.col("n_labelled") / F.col("n_documents"), 1)).otherwise(0.0))


@_q("SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_flags, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def alias_conflicts(spark, sf):
    g = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_returnflag").alias("n_flags"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    return g.where("n_flags > 1")


@_q("SELECT c_custkey, n_orders, n_actual FROM (SELECT c_custkey, (c_custkey % 20) AS n_orders, count(o_orderkey) AS n_actual FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) WHERE n_orders <> n_actual")
def counter_drift(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    actual = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(actual, "c_custkey", "left").select("c_custkey", (F.col("c_custkey") % 20).alias("n_orders"), F.coalesce("n", F.lit(0)).alias("n_actual")).where("n_orders <> n_actual")


@_q("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY 1, 2")
def embed_state_counts(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


@_q("SELECT lang, count(*) FILTER (WHERE quality = 1) AS pass, count(*) FILTER (WHERE quality = 0) AS fail, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 6) AS pass_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def pass_rate_pivot(spark, sf):
    j = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("pass"), F.count_if(F.col("quality") == 0).alias("fail"), F.round(100.0 * F.count_if(F.col("quality") == 1) / F.count(F.lit(1)), 6).alias("pass_rate"))


@_q("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 25")
def enum_sorted(spark, sf):
    o = _t(spark, sf, "orders")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return o.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


# ------------------------------------------------------------------ threads, timelines, graph
@_q("SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS root_role, list(turn ORDER BY turn)[2:] AS children FROM conversations GROUP BY conv_id")
def thread_root_children(spark, sf):
    g = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return g.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.col("t")[0]["role"].alias("root_role"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["turn"]).alias("children"))


@_q("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def speaker_turn_counts(spark, sf):
    return _t(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@_q("SELECT user_id, date_trunc('week', ts) AS period, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2")
def grouped_timeline(spark, sf):
    return G.grouped_timeline(_t(spark, sf, "events"), "user_id", "ts", "event_type").withColumn("period", F.col("period").cast("timestamp_ntz"))


@_q("SELECT event_id, user_id, event_type, event_type IN ('purchase', 'signup') AS is_milestone FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND event_type <> 'view'")
def event_milestones(spark, sf):
    e = _t(spark, sf, "events").where("ts between timestamp_ntz'2024-01-10' and timestamp_ntz'2024-01-20' and event_type <> 'view'")
    return e.select("event_id", "user_id", "event_type", F.col("event_type").isin("purchase", "signup").alias("is_milestone"))


@_q("SELECT (json_extract(props, '$.k'))::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props(spark, sf):
    e = _t(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_SQL_CHANGE = """a AS (SELECT user_id, date_diff('day', ts::DATE, DATE '2024-01-31') AS age, ts FROM events),
p AS (SELECT user_id, count(*) FILTER (WHERE age >= 0 AND age < 15) AS n_now, count(*) FILTER (WHERE age >= 15 AND age < 30) AS n_before, max(ts) AS last_at FROM a GROUP BY 1),
x AS (SELECT *, CASE WHEN n_before > 0 THEN (n_now - n_before) * 100.0 / n_before END::DOUBLE AS change_pct FROM p)"""


def _changes(spark, sf):
    return D.period_change(_t(spark, sf, "events"), "user_id", "ts", F.lit("2024-01-31").cast("date"), 15)


@_q(f"WITH {_SQL_CHANGE} SELECT user_id, n_now, n_before, round(change_pct, 6) AS change_pct, CASE WHEN change_pct >= 40 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE change_pct >= 10")
def activity_spike(spark, sf):
    return D.spikes(_changes(spark, sf), 10, 40).drop("last_at").withColumn("change_pct", F.round("change_pct", 6))


@_q(f"WITH {_SQL_CHANGE} SELECT user_id, n_now, n_before, round(change_pct, 6) AS change_pct, CASE WHEN change_pct <= -40 THEN 'critical' WHEN change_pct <= -20 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE change_pct <= -10")
def communication_drop(spark, sf):
    return D.drops(_changes(spark, sf), 10, 20, 40).drop("last_at").withColumn("change_pct", F.round("change_pct", 6))


@_q(
    """WITH l AS (SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY 1),
s AS (SELECT c_custkey, date_diff('day', last_at::DATE, DATE '2001-09-01') AS silence_days, CASE c_mktsegment WHEN 'BUILDING' THEN 14 WHEN 'MACHINERY' THEN 14 ELSE 21 END AS limit_days
FROM customer JOIN l ON o_custkey = c_custkey)
SELECT c_custkey, silence_days::INT AS silence_days, limit_days FROM s WHERE silence_days >= limit_days"""
)
def silence_days(spark, sf):
    last = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_at"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "vendor").when(F.col("c_mktsegment") == "MACHINERY", "regulator").otherwise("partner")
    rows = _t(spark, sf, "customer").select("c_custkey", kind.alias("kind")).join(last, "c_custkey")
    return D.silences(rows, "last_at", "kind", F.lit("2001-09-01").cast("date")).select("c_custkey", "silence_days", "limit_days")


@_q(
    f"""WITH {_SQL_COMMIT}, g AS (SELECT owner, count(*) FILTER (WHERE status_now = 'overdue') AS n_overdue, max(due) AS last_at, count(*) FILTER (WHERE value > 400000) AS n_risks FROM m GROUP BY owner),
s AS (SELECT *, date_diff('day', last_at::DATE, DATE '2001-09-01') AS d FROM g),
h AS (SELECT owner, greatest(0, least(1, 0.7 - CASE WHEN d >= 90 THEN 0.5 WHEN d >= 60 THEN 0.35 WHEN d >= 30 THEN 0.2 WHEN d >= 14 THEN 0.1 WHEN d >= 7 THEN 0.05 ELSE 0 END - 0.08 * n_overdue - 0.1 * n_risks)) AS s FROM s)
SELECT owner, round(s, 6)::DOUBLE AS health_score, CASE WHEN round(s, 6) >= 0.7 THEN 'healthy' WHEN round(s, 6) >= 0.45 THEN 'neutral' WHEN round(s, 6) >= 0.25 THEN 'attention_required' ELSE 'at_risk' END AS health FROM h"""
)
def health_score(spark, sf):
    g = _overdue(spark, sf).groupBy("owner").agg(F.count_if(F.col("status_now") == "overdue").alias("n_overdue"), F.max("due").alias("last_at"), F.count_if(F.col("value") > 400000).alias("n_risks"))
    rows = g.withColumns({"silence_days": F.datediff(F.lit("2001-09-01").cast("date"), F.col("last_at")), "n_escalations": F.lit(0), "trend_penalty": F.lit(0.0)})
    scored = D.health(rows).select("owner", F.round("health_score", 6).alias("health_score"))
    return scored.withColumn("health", X.band(F.col("health_score"), [("healthy", 0.7), ("neutral", 0.45), ("attention_required", 0.25), ("at_risk", 0.0)]))


def _edges(spark, sf):
    k = _t(spark, sf, "lineitem")
    seen = k.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("supplies").alias("type"), F.col("l_quantity").alias("strength"), F.col("l_orderkey").alias("evidence"), F.col("l_shipdate").alias("seen_at"))
    return G.upsert_edges(seen)


_SQL_EDGES = """e AS (SELECT l_suppkey AS source, l_partkey AS target, 'supplies' AS type, count(*) AS frequency, max(l_quantity) AS strength, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
  list_sort(list(DISTINCT l_orderkey))[1:100] AS evidence FROM lineitem GROUP BY 1, 2)"""


@_q(f"WITH {_SQL_EDGES} SELECT * FROM e")
def edge_upsert(spark, sf):
    return _edges(spark, sf)


@_q(f"WITH {_SQL_EDGES} SELECT source, target, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY frequency DESC, target)::INT AS rank FROM e) WHERE rank <= 5")
def neighbors_topn(spark, sf):
    return G.neighbours(_edges(spark, sf), 5).select("source", "target", "frequency", "rank")


@_q(f"WITH {_SQL_EDGES} SELECT source, target, NOT (date_diff('day', last_seen::DATE, DATE '2000-01-01') > 180 AND frequency < 3) AS is_active FROM e")
def stale_edges(spark, sf):
    return G.stale(_edges(spark, sf), F.lit("2000-01-01").cast("date")).select("source", "target", "is_active")


def _links(spark, sf):
    k = _t(spark, sf, "lineitem")
    return k.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target")).distinct()


@_q(
    """WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000 AS t FROM lineitem), b AS (SELECT s, t FROM p UNION SELECT t, s FROM p),
z AS (SELECT 1::BIGINT AS node), h1 AS (SELECT DISTINCT b.t AS node FROM z JOIN b ON b.s = z.node),
h2 AS (SELECT DISTINCT b.t AS node FROM h1 JOIN b ON b.s = h1.node WHERE b.t <> 1 AND b.t NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hop FROM z UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2"""
)
def bfs_depth2(spark, sf):
    return G.reach(_links(spark, sf), spark.createDataFrame([(1,)], "node long"), 2)


@_q()
def connected_components(spark, sf):
    return G.components(_links(spark, sf), "source", "target")


@_q("WITH m AS (SELECT DISTINCT o_custkey, o_orderpriority AS i FROM orders) SELECT x.i AS a, y.i AS b, count(*) AS together FROM m x JOIN m y ON x.o_custkey = y.o_custkey AND x.i < y.i GROUP BY 1, 2")
def co_occurrence(spark, sf):
    return G.co_occurrence(_t(spark, sf, "orders"), "o_custkey", "o_orderpriority")


# ------------------------------------------------------------------ identity
@_q("SELECT trim(regexp_replace(regexp_replace(lower(strip_accents(c_name)), '[^\\p{L}\\p{N}_\\s@.\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm_name, split_part(lower(c_name) || '@' || lower(c_mktsegment) || '.com', '@', 2) AS domain, c_custkey FROM customer")
def normalised_names(spark, sf):
    c = _t(spark, sf, "customer")
    mail = F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".com"))
    return c.select(X.normalise_name(F.col("c_name")).alias("norm_name"), X.email_domain(mail).alias("domain"), "c_custkey")


@_q("SELECT c_nationkey::VARCHAR || '|' || c_mktsegment AS key, count(*) AS n, min(c_custkey) AS first_id FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_entities(spark, sf):
    return E.duplicates(_t(spark, sf, "customer"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment"), "c_custkey")


@_q("SELECT c_custkey - c_custkey % 10 AS entity_id, min(c_name) AS name, list_sort(list(DISTINCT c_mktsegment)) AS emails, sum(c_nationkey)::BIGINT AS n_items, min(c_acctbal) AS first_seen, max(c_acctbal) AS last_seen, count(*) AS n_merged FROM customer GROUP BY 1")
def merged_entities(spark, sf):
    c = _t(spark, sf, "customer")
    e = c.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"), F.col("c_nationkey").alias("n_items"), F.col("c_acctbal").alias("first_seen"), F.col("c_acctbal").alias("last_seen"))
    return E.merge_entities(e, c.select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") - F.col("c_custkey") % 10).alias("canonical_id")))


@_q("WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT min(doc_id) AS first_id, sha256(text) AS h FROM documents WHERE sha256(text) NOT IN (SELECT h FROM old) GROUP BY text")
def idempotent_insert(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("h"))
    fresh = d.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return E.insert_new(d.where("doc_id % 2 = 0"), fresh, ["h"]).select("first_id", "h")


@_q(
    """WITH u AS (SELECT user_id, event_type, value, event_id FROM events)
SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM u GROUP BY 1, 2"""
)
def state_upsert(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return D.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id")


@_q(
    """SELECT user_id, CASE min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n_evidence FROM events GROUP BY 1"""
)
def risk_severity_upsert(spark, sf):
    s = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "medium").otherwise("low")
    return D.raise_severity(_t(spark, sf, "events").withColumn("severity", s), ["user_id"])


@_q(
    """WITH s AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch(ts) - epoch(p) > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(ts) AS first_at, max(ts) AS last_at FROM g GROUP BY 1, 2"""
)
def interaction_sessions(spark, sf):
    """A pause of more than six hours ends a session; partial sessions are merged before they are numbered."""
    at = F.session_window("ts", "6 hours 1 microsecond")
    e = _t(spark, sf, "events").groupBy("user_id", at.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("first_at")).cast("long")
    return e.select("user_id", number.alias("session"), "n_events", "first_at", "last_at")


from . import composed, grown, landed, remembered  # noqa: E402, F401  they register their queries
