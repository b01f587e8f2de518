"""Custom state with event-time timers, in the RocksDB state store.

A visit is a run of a user's events with gaps of at most `GAP` seconds. Users are dealt to `BUCKETS` by hash, as calls for
each user's state cost more than the work. A bucket's open events are a list state of columns; a timer stands where the earliest of
them could end a visit. When the watermark reaches it, all visits that can get no more events are given
out and removed, so state holds what the gap and the watermark's delay ask for, and users who don't come back
leave nothing behind. Events of a user may come in any order within that delay.

Nulls: events without a time are left out; a null user is a user like others; a null type is counted as an empty one. Events that
repeat are each counted. State goes on from the checkpoint where a stream was stopped.
"""

from __future__ import annotations

import contextlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.registry import Registry
from .windows import drained, event_stream

GAP = 30 * 60

#: Groups of users that share state and timers. A stream keeps the number it began with.
BUCKETS = 1024

#: Events in a row of the state.
BLOCK = 10_000

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_queries = Registry()


class Visits(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user_id array<bigint>, at array<bigint>, event_id array<bigint>, event_type array<string>")

    def _wake(self, first: int) -> None:
        """A timer where a visit that ends with the earliest open event would be over, unless there is an earlier one."""
        at = -(-(first + self.gap) // 1000)
        known = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if all(at < t for t in known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                users = [u if known else None for u, known in zip(part["user_id"].tolist(), part["known"].tolist())]
                at = part["at"].tolist()
                self.open.appendList(blocks(list(zip(users, at, part["event_id"].tolist(), part["event_type"].tolist()))))
                first = min(at) if first is None else min(first, *at)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        by_user = defaultdict(list)
        for block in self.open.get():
            for user, *event in zip(*block):
                by_user[user].append(tuple(event))
        now, done, rest, ends = timerValues.getCurrentWatermarkInMs() * 1000, [], [], []
        for user, events in by_user.items():
            over, left = ended(sorted(events), self.gap, now)
            done += [(user, *visit(v)) for v in over]
            rest += [(user, *e) for e in left]
            if left:
                last = left[0][0]
                for at, *_ in left:  # of the first visit that is still open
                    if at > last + self.gap:
                        break
                    last = at
                ends.append(last)
        self.open.put(blocks(rest)) if rest else self.open.clear()
        if rest:
            self.handle.registerTimer(-(-(min(ends) + self.gap) // 1000))
        if done:
            out = pd.DataFrame(done, columns=["user_id", "first_id", "n", "seconds", "kinds"])
            yield out.assign(user_id=pd.array([v[0] for v in done], "Int64"))  # not as floats beside a null

    def close(self) -> None:
        pass


def blocks(events: list[tuple]) -> list[tuple]:
    """Events as rows of columns, `BLOCK` events each."""
    return [tuple(map(list, zip(*events[i : i + BLOCK]))) for i in range(0, len(events), BLOCK)]


def ended(events: list[tuple], gap: int, now: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Sorted events, cut to the visits that are over at `now`, and the events of those that are not."""
    done, visit = [], []
    for e in events:
        if visit and e[0] > visit[-1][0] + gap:
            done.append(visit)
            visit = []
        visit.append(e)
    if visit:
        done.append(visit)
    over = [v for v in done if v[-1][0] + gap <= now]
    return over, [e for v in done if v[-1][0] + gap > now for e in v]


def visit(events: list[tuple]) -> tuple[int, int, float, str]:
    kinds = Counter(t or "" for *_, t in events)
    return events[0][1], len(events), (events[-1][0] - events[0][0]) / 1e6, ",".join(f"{k}:{n}" for k, n in sorted(kinds.items()))


def visits(events: DataFrame, gap: int = GAP, delay: str = "10 minutes") -> DataFrame:
    """user_id, first_id, n, seconds and kinds (type:count by type) of every visit that is over."""
    timed = events.where("ts is not null").withWatermark("ts", delay).select(F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket"), F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("user_id").isNotNull().alias("known"), "ts", F.unix_micros("ts").alias("at"), "event_id", F.coalesce("event_type", F.lit("")).alias("event_type"))
    return timed.groupBy("bucket").transformWithStateInPandas(Visits(gap), "user_id long, first_id long, n long, seconds double, kinds string", "Append", "EventTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB store for streams that start inside; the session's own setting is put back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def run(stream: DataFrame, path: str | None = None) -> DataFrame:
    """As `drained`, with the RocksDB store."""
    with rocksdb(stream.sparkSession):
        return drained(stream, path)


@_queries.query("""
WITH n AS (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n
), k AS (
  SELECT user_id, s, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS kinds FROM (SELECT user_id, s, event_type, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id, s
), v AS (
  SELECT user_id, s, arg_min(event_id, ts) AS first_id, count(*) AS n, date_diff('microsecond', min(ts), max(ts)) / 1000000 AS seconds
  FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
)
SELECT user_id, first_id, n, round(seconds, 3) AS seconds, kinds FROM v JOIN k USING (user_id, s)
""")
def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a stream of events, by timers."""
    return run(visits(event_stream(spark, sf_dir))).withColumn("seconds", F.round("seconds", 3))


QUERIES, SQL = _queries.queries, _queries.sql
