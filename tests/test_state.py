"""Visits by timers: any order, restarts and nulls."""

from __future__ import annotations

import datetime as dt
import random
import time

from brindle.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def plain(rows, gap, now):
    out = []
    for user in {r[2] for r in rows}:
        own = sorted(((int((r[1] - START).total_seconds() * 1e6), r[0], r[3] or "") for r in rows if r[2] == user and r[1] is not None))
        visit = []
        for e in [*own, (10**18, 0, "")]:
            if visit and e[0] > visit[-1][0] + gap * 1_000_000:
                if visit[-1][0] + gap * 1_000_000 <= now:
                    out.append((user, *state.visit(visit)))
                visit = []
            visit.append(e)
    return sorted(out, key=repr)


def rows_of(rng, n):
    return [(i, rng.choice([None, *[START + dt.timedelta(seconds=rng.randrange(3000))] * 9]), rng.choice([None, 1, 1, 2]), rng.choice([None, "a", "b"])) for i in range(n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_visits_equal_a_plain_scan_over_restarts(spark, tmp_path):
    """Three files, the last two after a stop; rows come in any order within the delay."""
    rng, path, out = random.Random(3), str(tmp_path / "in"), str(tmp_path / "out")
    rows = rows_of(rng, 120)
    last = (500, START + dt.timedelta(hours=9), 9, "z")
    write(spark, rows[:60], path)
    first = state.run(state.visits(stream(spark, path), 60, "2 hours"), out).collect()
    assert first == []  # the watermark is before all of them
    time.sleep(1.1)
    write(spark, rows[60:], path)
    time.sleep(1.1)
    write(spark, [last, last], path)
    got = state.run(state.visits(stream(spark, path), 60, "2 hours"), out).collect()
    assert sorted(map(tuple, got), key=repr) == plain([*rows, last], 60, int(7 * 3600e6))
    again = state.run(state.visits(stream(spark, path), 60, "2 hours"), out)  # nothing new: nothing lost or repeated
    assert again.count() == len(got)


def test_cutting_of_visits():
    events = [(0, 1, "a"), (5, 2, "a"), (5, 3, "b"), (16, 4, "a"), (40, 5, "a")]
    done, rest = state.ended(events, 10, 26)
    assert done == [events[:3], events[3:4]] and rest == events[4:]
    assert state.ended(events, 10, 25) == ([events[:3]], events[3:]) and state.ended([], 10, 99) == ([], [])
    assert state.visit(events[:3]) == (1, 3, 5e-6, "a:2,b:1")


def test_the_store_setting_is_put_back(spark, tmp_path):
    before = spark.conf.get(state.STORE)
    write(spark, rows_of(random.Random(1), 5), str(tmp_path / "in"))
    state.run(state.visits(stream(spark, str(tmp_path / "in"))), str(tmp_path / "out")).collect()
    assert spark.conf.get(state.STORE) == before


def test_users_share_calls_and_keep_their_ids(spark, tmp_path, monkeypatch):
    """300 users in 3 buckets, a null user and ids that no double holds."""
    monkeypatch.setattr(state, "BUCKETS", 3)
    assert [len(b[0]) for b in state.blocks([(u, 1, 2, "a") for u in range(state.BLOCK + 1)])] == [state.BLOCK, 1]
    users = [None, *(2**53 + 1 + 2 * i for i in range(299))]
    rows = [(i, START + dt.timedelta(minutes=j * 40), u, "a") for i, (u, j) in enumerate((u, j) for u in users for j in range(2))]
    write(spark, [*rows, (9000, START + dt.timedelta(days=1), 5, "z")], str(tmp_path / "in"))
    found = state.visits(stream(spark, str(tmp_path / "in")))
    got = state.run(found, str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, state.GAP, 10**15)
