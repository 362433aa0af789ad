"""Detectors as stateful streams, and the same as batch: silence that fires when nothing comes, and chasing counted in a sliding horizon.

Both work in event time: results depend on the events and the watermark, not on the order of arrival, as long as no event is later
than the watermark allows. State is a few numbers per key, and goes when it can no longer matter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
DAY_US = 1000 * DAY_MS


def with_timers(spark: SparkSession) -> None:
    """Sets the state store that the streams of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Silence(StatefulProcessor):
    """One number, the time of the key's last event, and one timer, the next tier's."""

    def __init__(self, tiers: list[int]):
        self.tiers = sorted(tiers)

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long, tier int")

    def _arm(self, last: int, tier: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if tier < len(self.tiers):
            self.last.update((last, tier))
            self.handle.registerTimer(-(-(last + self.tiers[tier] * DAY_US) // 1000))  # timers are in milliseconds
        else:
            self.last.clear()

    def _said(self, key, last: int, tier: int):
        import pandas as pd

        days = self.tiers[tier]
        return pd.DataFrame([(key[0], pd.Timestamp(last, unit="us"), days, pd.Timestamp(last + days * DAY_US, unit="us"))], columns=["key", "last_at", "silence_days", "fired_at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        times = sorted(t for frame in rows for t in frame["us"].tolist())
        last, tier = self.last.get() if self.last.exists() else (None, 0)
        for t in times:
            if last is not None and t <= last:
                continue  # an earlier event that came late changes nothing
            if last is not None:  # silence between two events that came together
                while tier < len(self.tiers) and last + self.tiers[tier] * DAY_US <= t:
                    yield self._said(key, last, tier)
                    tier += 1
            last, tier = t, 0
        if last is not None:
            self._arm(last, tier)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.last.exists():
            last, tier = self.last.get()
            yield self._said(key, last, tier)
            self._arm(last, tier + 1)

    def close(self) -> None:
        pass


_ALERT = "key string, last_at timestamp, silence_days int, fired_at timestamp"


def silence_alerts(events: DataFrame, key: str, ts: str, tiers: list[int], late: str = "1 day") -> DataFrame:
    """A stream of events -> key, last_at, silence_days, fired_at: a row when a key has been silent for so many days, once the
    watermark is there, for each tier that is reached before it is heard of again. Events come in order but for `late`."""
    typed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at")).where("key is not null and at is not null")
    typed = typed.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return typed.groupBy("key").transformWithStateInPandas(_Silence(tiers), _ALERT, "append", "eventTime")


def silence_history(events: DataFrame, key: str, ts: str, tiers: list[int], until) -> DataFrame:
    """The same rows of a table of events, fired until a time."""
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), at.alias("last_at")).where("key is not null and last_at is not null").distinct()
    rows = rows.withColumn("_next", F.lead("last_at").over(Window.partitionBy("key").orderBy("last_at")))
    days = F.explode(F.array(*map(F.lit, sorted(tiers))))
    fired = rows.select("key", "last_at", "_next", days.alias("silence_days")).withColumn("fired_at", F.timestamp_micros(F.unix_micros("last_at") + F.col("silence_days") * DAY_US))
    return fired.where((F.col("fired_at") <= F.coalesce("_next", until)) & (F.col("fired_at") <= until)).drop("_next")


class _Chased(StatefulProcessor):
    """Counts per day of the horizon, and a timer at each day's end."""

    def __init__(self, days: int, least: int):
        self.days, self.least = days, least

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "day long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        for frame in rows:
            for day, n in (frame["ms"] // DAY_MS).value_counts().items():
                day, n = int(day), int(n)
                n += self.counts.getValue((day,))[0] if self.counts.containsKey((day,)) else 0
                self.counts.updateValue((day,), (n,))
                self.handle.registerTimer((day + 1) * DAY_MS)
        return iter([])  # nothing is said before the day's end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        n = 0
        for (d,), (c,) in list(self.counts.iterator()):
            if d <= day - self.days - 1:
                self.counts.removeKey((d,))  # no later day looks back so far
            elif day - self.days < d <= day:
                n += c
        if n >= self.least:
            yield pd.DataFrame([(key[0], pd.Timestamp(day * DAY_MS, unit="ms").date(), n)], columns=["key", "day", "n"])

    def close(self) -> None:
        pass


def chased_days(messages: DataFrame, key: str, ts: str, days: int = 30, least: int = 2, late: str = "1 day") -> DataFrame:
    """A stream of messages -> key, day, n: at the end of each day with a message, how many came in the last `days` days, that one
    included, if there were `least` or more."""
    typed = messages.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at")).where("key is not null and at is not null")
    typed = typed.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return typed.groupBy("key").transformWithStateInPandas(_Chased(days, least), "key string, day date, n long", "append", "eventTime")


def chased_history(messages: DataFrame, key: str, ts: str, days: int = 30, least: int = 2) -> DataFrame:
    """The same rows of a table of messages; counts per day are combined first, so a busy key is a row per day."""
    day = F.unix_date(F.col(ts).cast("timestamp").cast("date"))
    by = messages.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("key").orderBy("_d").rangeBetween(-(days - 1), 0)
    return by.select("key", F.date_from_unix_date("_d").alias("day"), F.sum("_n").over(over).alias("n")).where(F.col("n") >= least)
