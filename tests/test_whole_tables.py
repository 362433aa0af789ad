"""Registered queries of the library see every row of their tables: brute force on small fixtures with ids of all sizes."""

import datetime
import math
from collections import defaultdict

import pytest

from lorekeep.operators.answering import ranked_by
from lorekeep.operators.entities import name_score
from lorekeep.plans import registry

LINES = [(order, part, supp, float(order % 7 + 1), line, datetime.datetime(1997 + order % 4, 1 + part % 12, 1)) for order, part, supp, line in [
    (1, 1, 1, 1), (2, 1, 1, 2), (3, 399, 1, 1), (4, 401, 1, 3), (5, 401, 2, 1), (6, 15_000, 2, 1), (7, 15_000, 3, 4), (8, 19_999, 9, 1), (9, 19_999, 9, 2), (10, 41, 9, 1), (11, 700, 5, 2), (12, 700, 5, 2)
]]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("lines"))
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_linenumber int, l_shipdate timestamp_ntz"
    spark.createDataFrame(LINES, schema).write.parquet(f"{sf}/lineitem.parquet")
    return sf


def test_edges_of_every_part(spark, lines):
    seen = defaultdict(list)
    for order, part, supp, quantity, _, at in LINES:
        seen[supp, part].append((order, quantity, at))
    got = {(r["source"], r["target"]): r for r in registry.QUERIES["edge_upsert"](spark, lines).collect()}
    assert got.keys() == seen.keys()
    for k, rows in seen.items():
        r = got[k]
        assert (r["frequency"], r["strength"], r["evidence"]) == (len(rows), max(q for _, q, _ in rows), sorted({o for o, _, _ in rows}))
        assert (r["first_seen"], r["last_seen"]) == (min(t for _, _, t in rows), max(t for _, _, t in rows))
    ranked = defaultdict(list)
    for supp, part in sorted(seen, key=lambda k: (-len(seen[k]), k[1])):
        ranked[supp].append(part)
    near = {(r["source"], r["rank"]): r["target"] for r in registry.QUERIES["neighbors_topn"](spark, lines).collect()}
    assert near == {(s, i): t for s, ts in ranked.items() for i, t in enumerate(ts[:5], 1)}
    as_of = datetime.datetime(2000, 1, 1)
    want = {k: not ((as_of - max(t for _, _, t in rows)).days > 180 and len(rows) < 3) for k, rows in seen.items()}
    assert {(r["source"], r["target"]): r["is_active"] for r in registry.QUERIES["stale_edges"](spark, lines).collect()} == want


def brute_hops(edges, start):
    near, hops = defaultdict(set), {start: 0}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    front = [start]
    while front:
        node = front.pop(0)
        for other in near[node] - hops.keys():
            hops[other] = hops[node] + 1
            front.append(other)
    return hops


def test_links_of_every_part(spark, lines):
    edges = {(supp, part + 1000000) for _, part, supp, *_ in LINES}
    want = {(n, h) for n, h in brute_hops(edges, 1).items() if h <= 2}
    assert {(r["node"], r["hop"]) for r in registry.QUERIES["bfs_depth2"](spark, lines).collect()} == want
    least = {(n, min(brute_hops(edges, n))) for e in edges for n in e}
    assert {(r["node"], r["component"]) for r in registry.QUERIES["connected_components"](spark, lines).collect()} == least


def test_names_of_every_pair(spark, tmp_path):
    customers = [(1, 7, "Acme Corp"), (2, 7, "Customer#000000012"), (3, 8, "Jon Smith"), (4, None, "Acme Corp")]
    suppliers = [(1, 7, "Acme Corporation"), (2, 7, "Supplier#000000099"), (3, 8, "Jon Smyth"), (4, 9, "Acme Corp")]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["c_custkey"], r["s_suppkey"]): r["name_score"] for r in registry.QUERIES["fuzzy_customer_pairs"](spark, str(tmp_path)).collect()}
    plain = lambda x: x.lower().replace("#", " ")
    want = {(c, s): round(name_score(plain(a), plain(b)), 6) for c, n, a in customers for s, m, b in suppliers if n == m}
    assert got == want and got[1, 1] >= 0.7


def test_ages_count_parts_of_a_second(spark, tmp_path):
    """An event just after a day's border is not yet a day older."""
    day = lambda d, us: datetime.datetime(2024, 1, d, 0, 0, 0, us)
    rows = [(1, day(17, 0)), (2, day(17, 1)), (3, day(16, 999_999)), (4, day(16, 0)), (5, day(30, 500_000)), (6, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["score"] for r in registry.QUERIES["timeline_search"](spark, str(tmp_path)).collect()}
    assert got == {1: round(math.exp(-14 / 90), 9), 2: round(math.exp(-13 / 90), 9), 3: round(math.exp(-14 / 90), 9), 5: 1.0}


def test_mails_are_counted_each_time(spark, tmp_path):
    texts = ["a@x.org and b@x.org and a@x.org", "a@x.org " * 50, "a@x.org " * 51, " ".join(f"n{i}@x.org" for i in range(51)), "no address here", None, "a@x.org"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["mails"] for r in registry.QUERIES["mails_in_texts"](spark, str(tmp_path)).collect()}
    assert got == {0: ["a@x.org", "b@x.org"], 1: ["a@x.org"]}


def test_copies_of_names_are_scored_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i % 2, f"Acme {i % 4}" if i % 5 else None) for i in range(60)], "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, i % 2, f"Acme {i % 2} Ltd") for i in range(30)], "s_suppkey long, s_nationkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, made = [], registry.E.with_name_score
    monkeypatch.setattr(registry.E, "with_name_score", lambda pairs, a, b: (seen.append(pairs.count()), made(pairs, a, b))[1])
    got = {(r["c_custkey"], r["s_suppkey"]): r["name_score"] for r in registry.QUERIES["fuzzy_customer_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(c, s): round(name_score(f"acme {c % 4}" if c % 5 else "", f"acme {s % 2} ltd"), 6) for c in range(60) for s in range(30) if c % 2 == s % 2}
    assert seen == [6]  # of 900


def test_scored_pairs_are_not_shuffled(spark, tmp_path):
    """Pairs of different names leave the join that made them: nothing is joined or exchanged above the scores."""
    spark.createDataFrame([(i, 7, f"Acme {i}") for i in range(9)], "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, 7, f"Zenith {i}") for i in range(300)], "s_suppkey long, s_nationkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.QUERIES["fuzzy_customer_pairs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert "Join" not in above and "Repartition" not in above
    got = {(r["c_custkey"], r["s_suppkey"]): r["name_score"] for r in found.collect()}
    assert got == {(c, s): round(name_score(f"acme {c}", f"zenith {s}"), 6) for c in range(9) for s in range(300)}


def test_a_text_is_lower_cased_once_for_each_bank_of_words(spark):
    rows = spark.createDataFrame([(1, "Board risk", 0.5, 3, "email", ["x"], "x")], "doc_id long, text string, relevance double, age_days int, source_type string, relationships array<string>, about string")
    plan = ranked_by(rows, "doc_id", ["company", "risk"], ["x"], 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 2 and plan.index("Generate") < plan.index("lower(text")  # below what makes a row for each class
