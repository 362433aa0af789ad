"""Published versions, change feeds with removals, histories and as-of joins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import store as S

FEED = "id string, seq long, deleted boolean, text string"
CHUNKS = "id string, seq long, chunk int, content string"


def chunks(records):
    return records.select("id", "seq", F.posexplode(F.split("text", " ")).alias("chunk", "content"))


def feed(spark, path):
    return S.FeedStore(spark, str(path), FEED, "id", "seq", {"chunks": (CHUNKS, chunks)})


def state(store, version=None):
    return {r["id"]: r["text"] for r in store.current(version).collect()}, sorted((r["id"], r["content"]) for r in store.rows_of("chunks", version).collect())


def test_late_repeated_and_removed(spark, tmp_path):
    s = feed(spark, tmp_path / "f")
    assert state(s) == ({}, [])
    send = lambda *rows: s.apply(spark.createDataFrame(rows, FEED))
    send(("a", 1, False, "one two"), ("b", 1, None, "x"), ("b", 1, False, "x"), (None, 1, False, "no key"), ("z", None, False, "no order"))
    assert state(s) == ({"a": "one two", "b": "x"}, [("a", "one"), ("a", "two"), ("b", "x")])
    send(("a", 5, True, None))
    send(("a", 3, False, "late"), ("b", 1, False, "x"))  # older than the removal; repeated
    assert state(s) == ({"b": "x"}, [("b", "x")])
    assert state(s, 1)[0] == {"a": "one two", "b": "x"}  # as it was
    s.compact()
    send(("a", 4, False, "later still"))
    assert state(s) == ({"b": "x"}, [("b", "x")])
    send(("a", 6, False, "back"), ("b", 2, False, "y z"))
    assert state(s) == ({"a": "back", "b": "y z"}, [("a", "back"), ("b", "y"), ("b", "z")])
    s.compact(F.col("seq") < 100)
    assert s.folders() == 2 and s.tables.forget() > 0 and state(s)[0] == {"a": "back", "b": "y z"}


def test_any_order_of_arrival_gives_one_result(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(12)}", n, rng.random() < 0.3, f"t{n}") for n in range(80)]
    want = {}
    for k, _, d, t in rows:
        want[k] = None if d else t
    want = {k: t for k, t in want.items() if t}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        s = feed(spark, tmp_path / f"o{seed}")
        for at in range(0, 80, 27):
            s.apply(spark.createDataFrame(rows[at : at + 30], FEED))
            if at:
                s.compact()
        assert state(s) == (want, sorted((k, t) for k, t in want.items()))


def test_a_stream_of_changes(spark, tmp_path):
    landing = tmp_path / "in"
    s = feed(spark, tmp_path / "s")
    for n, rows in enumerate([[("a", 1, False, "x"), ("b", 2, False, "y")], [("a", 9, True, None)], [("a", 5, False, "late"), ("b", 2, False, "y"), ("c", 1, False, "z w")]]):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").json(str(landing))
        q = s.follow(spark.readStream.schema(FEED).json(str(landing)), str(tmp_path / "cp"), most_folders=3)
        q.awaitTermination(120)
        assert q.exception() is None, n
    assert state(s) == ({"b": "y", "c": "z w"}, [("b", "y"), ("c", "w"), ("c", "z")])
    assert s.folders() <= 4


def test_all_or_nothing(spark, tmp_path, monkeypatch):
    t = S.Tables(spark, str(tmp_path / "t"))
    one = spark.range(3)
    assert t.version() == 0 and t.read("a", "id long").count() == 0
    t.publish({"a": one, "b": one})
    broken = one.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        t.publish({"a": one, "b": broken})
    assert t.version() == 1 and t.read("a", "id long").count() == 3 and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert t.publish({"a": one}, {"b": spark.range(1)}) == 2
    assert (t.read("a", "id long").count(), t.read("b", "id long").count(), t.read("b", "id long", 1).count()) == (6, 1, 3)
    monkeypatch.setattr(t, "version", lambda: 1)
    with pytest.raises(S.Conflict):
        t.publish({"a": one})
    monkeypatch.undo()
    assert t.version() == 2 and t.read("a", "id long").count() == 6
    assert t.forget() == 1 and t.read("b", "id long").count() == 1


def test_history_and_as_of(spark):
    day = datetime(2024, 1, 1)
    at = lambda d, h=0: day + timedelta(days=d, hours=h)
    seen = spark.createDataFrame([("a", at(0), "x"), ("a", at(1), "x"), ("a", at(2), "y"), ("a", at(2), "w"), ("a", at(40), None), ("b", at(3), "q")], "k string, at timestamp, v string")
    got = sorted((r["k"], r["valid_from"], r["v"], r["valid_to"]) for r in S.history(seen, "k", "at", ["v"]).collect())
    assert got == [("a", at(0), "x", at(2)), ("a", at(2), "y", at(40)), ("a", at(40), None, None), ("b", at(3), "q", None)]
    rng = random.Random(1)
    versions = [(rng.choice("ab"), at(rng.randrange(60), rng.randrange(24)), n) for n in range(40)] + [(None, at(1), 1), ("a", None, 2)]
    facts = [(n, rng.choice(["a", "b", "c", None]), rng.choice([at(rng.randrange(-5, 80), rng.randrange(24)), None])) for n in range(90)]
    v, f = spark.createDataFrame(versions, "k string, since timestamp, n int"), spark.createDataFrame(facts, "id int, k string, at timestamp")
    want = {}
    for i, k, t in facts:
        known = [(s, n) for kk, s, n in versions if k is not None and t is not None and kk == k and s is not None and s <= t]
        want[i] = max(known)[1] if known else None
    for days in (1, 7, 100):
        assert {r["id"]: r["n"] for r in S.as_of(f, v, "k", "at", "since", ["n"], days).collect()} == want
    assert S.as_of(f.where("false"), v, "k", "at", "since", ["n"]).count() == 0
