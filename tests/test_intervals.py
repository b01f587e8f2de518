"""Overlap joins against all pairs, their covers and their plans."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from brindle.operators import intervals
from brindle.plans import catalog


def spans(rng, n):
    """Points, short and very long intervals, ties, nulls and intervals that end before they begin."""
    out = []
    for i in range(n):
        low = rng.choice([None, 0, 0, -50, *range(-30, 300, 7)])
        size = rng.choice([None, 0, 0, 1, 3, 9, 64, 65, 100, 700, -4])
        out.append((rng.choice([None, 1, 1, 2]), i, low, None if low is None or size is None else low + size))
    return out + out[:5]


def overlap(a, b):
    return None not in (a[2], a[3], b[2], b[3]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]


@pytest.mark.parametrize("unit", [1, 2.5, 16, 1000])
def test_overlaps_equal_all_pairs(spark, unit):
    rng = random.Random(int(unit))
    a, b = spans(rng, 90), spans(rng, 70)
    left, right = spark.createDataFrame(a, "k int, i int, lo int, hi int"), spark.createDataFrame(b, "k2 int, j int, lo2 int, hi2 int")
    for on in ([], [("k", "k2")]):
        got = intervals.overlap_join(left, ("lo", "hi"), right, ("lo2", "hi2"), unit, on)
        want = sorted((x[1], y[1]) for x in a for y in b if overlap(x, y) and (not on or (x[0] is not None and x[0] == y[0])))
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want and got.columns == ["k", "i", "lo", "hi", "k2", "j", "lo2", "hi2"]


def test_covers_are_whole_disjoint_and_small(spark):
    rng = random.Random(9)
    rows = [(i, low := rng.randrange(-5000, 5000), low + rng.choice([0, 5, 63, 64, 1000, 2_000_000])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, lo long, hi long")
    n = intervals.levels(df, "lo", "hi", 1)
    found = {}
    for r in intervals.covered(df, "lo", "hi", 1, n).collect():
        size = intervals.FAN ** r["__cell_level"]
        found.setdefault(r["i"], []).append((r["__cell"] * size, (r["__cell"] + 1) * size))
    for i, low, high in rows:
        cells = sorted(found[i])
        assert cells[0][0] == low and cells[-1][1] == high + 1 and all(a[1] == b[0] for a, b in zip(cells, cells[1:]))
        assert len(cells) <= 2 * intervals.FAN * n


def test_times_and_empty_tables(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m, 0, 500)
    left = spark.createDataFrame([(1, at(0), at(5)), (2, at(6), at(6)), (3, at(50), at(59))], "i int, a timestamp, b timestamp").withColumn("b", intervals.F.col("b"))
    right = spark.createDataFrame([(7, at(5), at(6)), (8, at(10), at(20))], "j int, c timestamp, d timestamp")
    got = intervals.overlap_join(left, ("a", "b"), right, ("c", "d"), 60).collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(1, 7), (2, 7)]
    assert intervals.overlap_join(left.limit(0), ("a", "b"), right, ("c", "d"), 60).collect() == []
    assert intervals.overlap_join(left, ("a", "b"), right.limit(0), ("c", "d"), 60).collect() == []


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="both"):
        intervals.overlap_join(df, ("a", "b"), df, ("a", "b"), 1)


@pytest.mark.parametrize("name", sorted(intervals.QUERIES))
def test_plans_have_no_nested_loop(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Join" in plan


@pytest.mark.parametrize("unit", [1, 16])
def test_overlaps_within_a_table_are_found_once(spark, unit):
    """Each pair of two rows once, the one that begins first in front; ties by row."""
    rows = [(k, i, low, high) for i, (k, _, low, high) in enumerate(spans(random.Random(unit), 90))]
    df = spark.createDataFrame(rows, "k int, i int, lo int, hi int")
    for on in ([], ["k"]):
        got = intervals.self_overlap_join(df, "i", ("lo", "hi"), unit, on).collect()
        want = sorted((x[1], y[1]) for x in rows for y in rows if overlap(x, y) and (x[2], x[1]) < (y[2], y[1]) and (not on or (x[0] is not None and x[0] == y[0])))
        assert sorted((r["i"], r["other_i"]) for r in got) == want


def test_deliveries_are_read_and_joined_once(spark, data):
    """The lines are grouped once, into a written table, and one join of points with intervals gives the pairs."""
    plan = catalog.QUERIES["overlapping_deliveries"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "l_shipdate" not in plan and "Aggregate" not in plan
