"""Ties and nulls in joins on time, and streams against their batch twins."""

from __future__ import annotations

import datetime as dt
import random

from brindle.operators.relational import not_in
from brindle.operators.temporal import asof_join, interval_join, sessionized
from brindle.streaming import windows


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 0, minute)


def test_asof_takes_a_right_row_of_the_same_time(spark):
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(1), "b"), (2, at(5), "c")], "k int, ts timestamp, name string")
    right = spark.createDataFrame([(1, at(5), 1.0), (1, at(3), 2.0), (2, at(6), 3.0)], "k int, ts timestamp, v double")
    got = asof_join(left, right, "k", "ts", "v", "seen").select("name", "seen").collect()
    assert [tuple(r) for r in got] == [("a", 1.0)]


def test_interval_join_bounds_are_closed(spark):
    left = spark.createDataFrame([(1, at(0)), (None, at(0))], "k int, a timestamp")
    right = spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(11)), (None, at(1))], "k int, b timestamp")
    got = interval_join(left, right, "k", "a", "b", 600)
    assert sorted(r["b"].minute for r in got.collect()) == [0, 10]


def test_asof_over_buckets_equals_a_plain_scan(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    times = lambda n: [(rng.choice([1, 1, 1, 2, None]), start + dt.timedelta(hours=rng.randrange(300)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(n)]
    left, right = times(200), times(60)
    got = asof_join(spark.createDataFrame([(k, t, i) for i, (k, t, _) in enumerate(left)], "k int, ts timestamp, i int"), spark.createDataFrame(right, "k int, ts timestamp, v double"), "k", "ts", "v", "seen", 7200)
    want = set()
    for i, (k, t, _) in enumerate(left):
        fit = [(s, v) for q, s, v in right if q is not None and q == k and s <= t and v is not None]
        if fit:
            want.add((i, max(fit)[1]))
    assert {(r["i"], r["seen"]) for r in got.collect()} == want and got.columns == ["k", "ts", "i", "seen"]


def test_sessions_over_buckets_equal_a_plain_scan(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 2, None]), start + dt.timedelta(minutes=rng.randrange(4000)), i) for i in range(300)]
    want = {}
    for k in (1, 2, None):
        number, last = 0, None
        for t, i in sorted((t, i) for q, t, i in rows if q == k):
            number += last is None or t - last > dt.timedelta(minutes=20)
            want[i], last = number, t
    for seconds in (600, 3600, 10**6):
        got = sessionized(spark.createDataFrame(rows, "k int, ts timestamp, i int"), "k", "ts", "i", 1200, seconds)
        assert {r["i"]: r["session"] for r in got.collect()} == want


def test_not_in_and_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    lists = {(): {1, 2, None}, (1,): {2}, (1, None): set(), (None,): set()}
    for listed, want in lists.items():
        got = not_in(left, "a", spark.createDataFrame([(x,) for x in listed], "b int"), "b")
        assert {r["a"] for r in got.collect()} == want


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    # A batch drops what is older than the watermark of the batch before it, so the late row comes last of four.
    for i, (hour, minute) in enumerate(((0, 0), (3, 59), (4, 0), (0, 1))):
        row = (i, dt.datetime(2024, 1, 1, hour, minute), 1, "view", 1.0, "{}")
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = windows.drained(windows.hourly(stream)).collect()
    assert [(r["start"].hour, r["n"]) for r in got] [:1] == [(0, 1)]


def test_custom_state_equals_batch(spark, data):
    stream = windows.counted_by_user(windows.event_stream(spark, data))
    got = {r["user_id"]: r["n"] for r in windows.latest(stream, "user_id").collect()}
    want = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{data}/events.parquet").groupBy("user_id").count().collect()}
    assert got == want
