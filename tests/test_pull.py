"""Pulling with made-up transports: no network."""

import json

import pytest

from lorekeep.sources import pull


def test_retries_and_pauses():
    slept, left = [], [ValueError, ValueError, None]

    def flaky():
        e = left.pop(0)
        if e:
            raise e("x")
        return 7

    assert pull.with_retry(flaky, 3, slept.append) == 7 and slept == [1.0, 2.0]
    assert [pull.pause(n) for n in (0, 3, 20)] == [1.0, 8.0, 300.0]
    with pytest.raises(ZeroDivisionError):
        pull.with_retry(lambda: 1 / 0, 2, slept.append)


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = pull.RateLimit(2, lambda: now[0], sleep)
    for _ in range(5):
        limit.wait()
        now[0] += 0.1
    assert [round(s, 6) for s in slept] == [0.8, 0.8]


def test_get():
    said, slept = [], []

    def send(url, token):
        said.append(token)
        return {1: pull.Response(429, headers={"Retry-After": "5"}), 2: pull.Response(401), 3: pull.Response(200, {"ok": 1})}[len(said)]

    assert pull.get(send, "u", "old", lambda: "new", sleep=slept.append) == {"ok": 1}
    assert said == ["old", "old", "new"] and slept == [5.0]
    with pytest.raises(ConnectionError):
        pull.get(lambda u, t: pull.Response(401), "u", "t")
    with pytest.raises(ConnectionError):
        pull.get(lambda u, t: pull.Response(500), "u", "t", sleep=slept.append)
    with pytest.raises(ConnectionError):
        pull.get(lambda u, t: pull.Response(429), "u", "t", sleep=slept.append)


def test_tokens_and_results():
    t = pull.Token("x", 1000.0)
    assert not t.expired(939) and t.expired(940)
    assert pull.SyncResult("c").success_rate == 1.0 and pull.SyncResult("c", found=4, stored=3).success_rate == 0.75

    class Down(pull.Connector):
        def authenticate(self):
            raise OSError("down")

    assert pull.health({"a": pull.Connector(), "b": Down()}) == [("a", True, ""), ("b", False, "OSError: down")]


def test_pulled_and_embedded(spark):
    class Pages(pull.Connector):
        name = "pages_of_a_test"

        def shards(self):
            return ["a", "b"]

        def fetch(self, shard, cursor):
            page = int(cursor or 0)
            return [{"id": f"{shard}{page}{i}"} for i in range(2)], str(page + 1) if page < 2 else None

    rows = pull.pulled(spark, Pages()).collect()
    assert sorted(json.loads(r["record"])["id"] for r in rows) == [f"{s}{p}{i}" for s in "ab" for p in range(3) for i in range(2)]
    assert {(r["shard"], r["position"]) for r in rows} == {(s, i) for s in "ab" for i in range(6)}
    late = pull.pull_source(Pages(), since="2")
    spark.dataSource.register(late)
    assert spark.read.format("pages_of_a_test").load().count() == 4
    chunks = spark.createDataFrame([(f"k{i}", "x" * i) for i in range(70)], "chunk_id string, text string")
    got = {r["chunk_id"]: r["vector"] for r in pull.embed(chunks, lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()}
    assert len(got) == 70 and got["k5"] == [5.0, 1.0]
    with pytest.raises(Exception, match="dimension"):
        pull.embed(chunks, lambda texts: [[1.0] for _ in texts], 2, retries=0).collect()
