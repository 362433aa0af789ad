"""The vector index: recall, filters, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from lorekeep.operators.vectors import VectorIndex, nearest, probes_for


def test_recall_and_exact_way(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    data = [(i, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=16)], i % 3) for i in range(1500)]
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [1.0, None] + [0.0] * 14, 0), (9005, [float("nan")] * 16, 0), (9006, [1.0] * 5, 0)]
    rows = spark.createDataFrame(data + odd, "id long, v array<double>, kind int")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows, "id", "v", lists=24)
    known = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data}
    assert index._centres()[1] < 24  # some lists stay unread
    asked = [i for i in known if i % 50 == 0]
    queries = rows.where(F.col("id").isin(asked)).select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    got = {}
    for r in index.search_many(queries, 10, "id", "v").collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    hit = 0
    for i in asked:
        best = sorted(known, key=lambda j: (-known[i] @ known[j], j))[:10]  # noqa: B023
        hit += len(got[i] & set(best))
        if i % 500 == 0:
            exact = [r["id"] for r in index.search(list(known[i]), 10, "id", "v", exact=True).collect()]
            assert exact == best
            some = [r["id"] for r in index.search(list(known[i]), 5, "id", "v", F.col("kind") == 1, exact=True).collect()]
            assert some == sorted((j for j in known if j % 3 == 1), key=lambda j: (-known[i] @ known[j], j))[:5]  # noqa: B023
    assert hit >= 0.9 * 10 * len(asked)


def test_empty_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "e"))
    index.build(spark.createDataFrame([], "id long, v array<float>"), "id", "v")
    assert index.search([1.0], 3, "id", "v").count() == 0
    assert probes_for(np.eye(2)[:1], np.eye(2)[:1]) == 1


def test_blocks_find_what_all_pairs_do(spark, monkeypatch):
    """Rows and queries in several blocks, copies among them, with and without groups; pairs are scored as matrices, not row by row."""
    monkeypatch.setattr("lorekeep.operators.vectors.BLOCK", 20)
    rng = np.random.default_rng(4)
    made = rng.normal(size=(90, 6))
    made[50:60] = made[3]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(made)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, kind int")
    asked = vectors.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"), "kind")
    for group in (None, "kind"):
        got = {(r["query_id"], r["rank"], r["id"]) for r in nearest(asked, vectors, 4, "id", "v", group).collect()}
        want = set()
        for i, v, g in rows[::2]:
            score = lambda w: max(0.0, sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5))
            best = sorted((-round(score(w), 12), j) for j, w, h in rows if group is None or g == h)[:4]
            want |= {(i, r, j) for r, (_, j) in enumerate(best, 1)}
        assert got == want
    assert "cogroup" in nearest(asked, vectors, 4, "id", "v")._jdf.queryExecution().toString().lower()
