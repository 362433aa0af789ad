"""Stateful detectors: the stream gives what the batch gives, whatever the order of arrival."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.streaming import watchers as W

DAY = datetime(2024, 1, 1)
SCHEMA = "who string, at timestamp"


def events(seed):
    rng = random.Random(seed)
    out = []
    for who in ("a", "b", "c"):
        at = DAY
        for _ in range(12):
            at += timedelta(hours=rng.choice((1, 5, 20, 30, 100, 200, 400)))
            out.append((who, at))
    return sorted(out, key=lambda x: x[1])


def run(spark, tmp_path, rows, make):
    """Feeds rows in batches, some rows a batch late; the last event moves the watermark past all timers."""
    landing, name = tmp_path / "in", f"out_{abs(hash(str(tmp_path)))}"
    W.with_timers(spark)
    batches = [rows[i : i + 7] for i in range(0, len(rows), 7)]
    for x, y in zip(batches, batches[1:]):
        if len(x) > 2 and y[-1][1] - x[-1][1] < timedelta(days=8):
            y.append(x.pop())  # arrives late
    batches.append([("end", rows[-1][1] + timedelta(days=400))])
    batches.append([("end", rows[-1][1] + timedelta(days=401))])
    out = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
        q = make(spark.readStream.schema(SCHEMA).parquet(str(landing))).writeStream.foreachBatch(lambda df, e: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, n
    return sorted(r for r in out if r[0] != "end")


def test_silence_fires_when_nothing_comes(spark, tmp_path):
    rows = events(1)
    got = run(spark, tmp_path, rows, lambda s: W.silence_alerts(s, "who", "at", [3, 7], "9 days"))
    table = spark.createDataFrame(rows, SCHEMA)
    want = W.silence_history(table, "who", "at", [3, 7], F.lit(rows[-1][1] + timedelta(days=300)))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 6
    assert W.silence_history(table.where("false"), "who", "at", [3], F.current_timestamp()).count() == 0


def test_chasing_in_a_sliding_horizon(spark, tmp_path):
    rows = events(2)
    got = run(spark, tmp_path, rows, lambda s: W.chased_days(s, "who", "at", 5, 3, "9 days"))
    table = spark.createDataFrame(rows, SCHEMA)
    want = W.chased_history(table, "who", "at", 5, 3)
    assert got == sorted(map(tuple, want.collect())) and got
    for who, day, n in got:
        assert n == sum(w == who and timedelta(0) <= datetime.combine(day, datetime.min.time()) - datetime.combine(t.date(), datetime.min.time()) < timedelta(days=5) for w, t in rows)
