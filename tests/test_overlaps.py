"""Counts of overlaps against all pairs, and that no pairs are made."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from brindle.operators import intervals, overlaps


def spans(rng, n, owners, sizes):
    """Intervals of some owners that don't touch, with ties between owners."""
    out = []
    for owner in range(owners):
        at = rng.randrange(6)
        for _ in range(n):
            high = at + rng.choice(sizes)
            out.append((len(out), owner, at, high))
            at = high + rng.choice([1, 1, 2, 5, 30])
    return out


def plain(rows):
    out = {}
    for row, owner, low, high in rows:
        found = [(o, min(high, h) - max(low, b)) for r, o, b, h in rows if r != row and b <= high and low <= h]
        if found:
            out[row] = (len(found), len({o for o, _ in found}), max(x for _, x in found))
    return out


@pytest.mark.parametrize("sizes", [[0], [0, 1, 3, 40], [5, 100]])
def test_counts_equal_all_pairs(spark, sizes):
    rows = spans(random.Random(len(sizes)), 15, 12, sizes)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a small table is one range
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = overlaps.overlap_counts(spark.createDataFrame(rows, "row long, owner int, low long, high long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["row"]: tuple(r)[1:] for r in got} == plain(rows)


def test_dominated_points_equal_a_plain_count():
    rng = np.random.default_rng(2)
    for n, m in ((0, 3), (1, 5), (64, 40), (301, 99), (5, 0)):
        x, y, least, most = (rng.integers(0, 50, k) for k in (n, n, m, m))
        assert overlaps.dominated(x, y, least, most).tolist() == [int(((x >= a) & (y <= b)).sum()) for a, b in zip(least, most)]


def test_shared_ids_are_counted_together(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, 7, at(0), at(2)), (2, 7, at(1), at(3)), (3, 8, at(2), at(9)), (3, 9, at(20), at(21)), (None, 5, at(0), at(9)), (4, 6, None, None)]
    sessions = spark.createDataFrame(rows, "user_id long, id long, low timestamp, high timestamp")
    got = {r["id"]: tuple(r)[1:] for r in intervals.session_overlaps(sessions).collect()}
    hour = 3_600_000_000
    assert got == {7: (4, 3, hour), 8: (2, 2, hour)}


def test_the_query_makes_no_pairs(spark):
    """200 sessions at one time are 39,800 pairs; no operator of the plan may give that many rows."""
    rows = [(u, u, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)) for u in range(200)]
    df = intervals.session_overlaps(spark.createDataFrame(rows, "user_id long, id long, low timestamp, high timestamp"))
    assert {tuple(r)[1:] for r in df.collect()} == {(199, 199, 86_400_000_000)}
    assert "__cell" not in df._jdf.queryExecution().executedPlan().toString()
