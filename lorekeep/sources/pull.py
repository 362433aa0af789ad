"""Pulling records out of services: retries, rate limits, tokens, and a Spark data source over any paged fetch function.

No transport is built in: a fetch function (shard, cursor) -> (records, next cursor or None), or a send function (url, token) ->
Response, is given by the caller. Records land as JSON and go on through normalise.py and streaming/sync.py.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Retries, their growing pauses, requests a second, pauses of a limited service, margins of tokens (seconds).
RETRIES, BACKOFF_BASE, BACKOFF_MOST, PER_SECOND, LIMIT_PAUSE, TOKEN_MARGIN = 3, 2.0, 300.0, 5.0, 60, 60


def pause(attempt: int, base: float = BACKOFF_BASE, most: float = BACKOFF_MOST) -> float:
    return min(base**attempt, most)


def with_retry(f: Callable, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, base: float = BACKOFF_BASE, most: float = BACKOFF_MOST):
    """The result of f(); errors are tried again after growing pauses, the last one is raised."""
    for attempt in range(retries + 1):
        try:
            return f()
        except Exception:
            if attempt == retries:
                raise
            sleep(pause(attempt, base, most))


class RateLimit:
    """At most per_second calls of wait() in any second."""

    def __init__(self, per_second: float = PER_SECOND, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.clock, self.sleep, self.times = per_second, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.times and now - self.times[0] >= 1.0:
            self.times.popleft()
        if len(self.times) >= self.most:
            self.sleep(max(0.0, 1.0 - (now - self.times[0])))
            now = self.clock()
        self.times.append(now)


@dataclass
class Token:
    """An access token and when it ends; used up a little earlier."""

    value: str
    ends_at: float
    refresh_value: str | None = None

    def expired(self, now: float, margin: float = TOKEN_MARGIN) -> bool:
        return now >= self.ends_at - margin


@dataclass
class Response:
    status: int
    body: object = None
    headers: dict = field(default_factory=dict)


def get(send: Callable[[str, str], Response], url: str, token: str, refresh: Callable[[], str | None] = lambda: None, tries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> object:
    """The body behind a URL: waits where the service says it is busy (429), takes a new token once it says no (401), and tries other
    failures again after growing pauses."""
    for attempt in range(tries):
        last = attempt == tries - 1
        answer = send(url, token)
        if answer.status == 429:
            sleep(float(answer.headers.get("Retry-After", LIMIT_PAUSE)))
        elif answer.status == 401:
            new = refresh()
            if new is None:
                raise ConnectionError(f"{url}: the token is refused and cannot be refreshed")
            token = new
        elif answer.status >= 400:
            if last:
                raise ConnectionError(f"{url}: status {answer.status}")
            sleep(pause(attempt))
        else:
            return answer.body
    raise ConnectionError(f"{url}: no answer after {tries} tries")


class Connector:
    """The contract of a service: what a subclass gives is asked in this order."""

    name = ""

    def authenticate(self) -> bool:
        return True

    def shards(self) -> list[str]:
        """Parts that can be pulled side by side: folders, channels, drives."""
        return [""]

    def fetch(self, shard: str, cursor: str | None) -> tuple[list[dict], str | None]:
        """A page of raw records and the cursor of the next one."""
        raise NotImplementedError

    def normalise(self, raw: DataFrame) -> DataFrame:
        raise NotImplementedError


def pull_source(connector: Connector, since: str | None = None, retries: int = RETRIES, per_second: float = PER_SECOND) -> type[DataSource]:
    """A Spark data source named after the connector: shard, position, record (JSON), cursor. Each shard is one partition, pulled by an
    executor with retries and within the rate limit; `since` is the first cursor of all shards."""

    class Shard(InputPartition):
        def __init__(self, name: str):
            self.name = name

    class Reader(DataSourceReader):
        def partitions(self):
            return [Shard(s) for s in connector.shards()]

        def read(self, partition) -> Iterator[tuple]:
            limit, cursor, at = RateLimit(per_second), since, 0
            while True:
                limit.wait()
                records, following = with_retry(lambda c=cursor: connector.fetch(partition.name, c), retries)
                for r in records:
                    yield partition.name, at, json.dumps(r, sort_keys=True), cursor
                    at += 1
                if following is None:
                    return
                cursor = following

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return connector.name

        def schema(self) -> str:
            return "shard string, position long, record string, cursor string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def pulled(spark: SparkSession, connector: Connector, since: str | None = None) -> DataFrame:
    spark.dataSource.register(pull_source(connector, since))
    return spark.read.format(connector.name).load()


def health(connectors: dict[str, Connector]) -> list[tuple[str, bool, str]]:
    """name, healthy, detail of each connector; one that fails does not stop the others."""
    out = []
    for name, c in connectors.items():
        try:
            ok = bool(c.authenticate())
            out.append((name, ok, "" if ok else "authentication failed"))
        except Exception as e:
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out


@dataclass
class SyncResult:
    """What a run did."""

    connector: str
    found: int = 0
    stored: int = 0
    failed: int = 0
    skipped: int = 0
    cursor: str | None = None

    @property
    def success_rate(self) -> float:
        return 1.0 if not self.found else self.stored / self.found


def embed(chunks: DataFrame, call: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 32, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """chunk_id, vector of chunks (chunk_id, text) by a model's function on lists of texts, in batches, with retries; a vector of
    another dimension is an error."""

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                vectors = with_retry(lambda texts=part.column(1).to_pylist(): call(texts), retries, sleep)
                if any(len(v) != dimension for v in vectors):
                    raise ValueError(f"a vector's dimension isn't {dimension}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["chunk_id", "vector"])

    return chunks.select("chunk_id", "text").mapInArrow(run, "chunk_id string, vector array<double>")
