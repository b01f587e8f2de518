"""Global numbers, ranks and running totals against plain scans, and their plans."""

from __future__ import annotations

import random

import pytest

from brindle.operators import ordered
from brindle.plans import catalog


def key(x):
    return (x is not None, x)  # nulls first


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_running_sums_of_keys_equal_a_plain_scan(spark, hot):
    rng = random.Random(int(hot * 10) + 1)
    rows = [(1 if rng.random() < hot else rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), i, rng.choice([None, None, 1, 5, -3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v long").repartition(7)
    for by in ([], ["k"], ["k", "t"]):
        want, sums = {}, {}
        for k, t, i, v in sorted(rows, key=lambda r: (*((key(r[0]),) if "k" in by else ()), key(r[1]), r[2])):
            group = tuple({"k": k, "t": t}[b] for b in by)
            if v is not None:
                sums[group] = sums.get(group, 0) + v
            want[i] = sums.get(group)
        got = ordered.cumulated(df, ["t", "i"], {"total": "v"}, by)
        assert {r["i"]: r["total"] for r in got.collect()} == want and got.columns == [*df.columns, "total"]


def test_ranks_with_ties_and_nulls_equal_a_plain_scan(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, 7, 7, *range(12)]), i) for i in range(230)]
    df = spark.createDataFrame(rows, "p int, i int")
    for names, down in ((["p"], False), (["-p"], True)):
        order = sorted(rows, key=lambda r: ((r[0] is None, -(r[0] or 0)) if down else key(r[0]), r[1]))
        want, rank, dense = {}, 0, 0
        for n, (p, i) in enumerate(order, 1):
            if n == 1 or order[n - 2][0] != p:
                rank, dense = n, dense + 1
            wide, more = divmod(len(rows), 9)
            tile = (n - 1) // (wide + 1) + 1 if n <= more * (wide + 1) else more + (n - more * (wide + 1) - 1) // wide + 1
            want[i] = (n, rank, dense, round((rank - 1) / (len(rows) - 1), 9), tile)
        got = ordered.ranked(df, names, ["i"], 9).collect()
        assert {r["i"]: (r["row_number"], r["rank"], r["dense_rank"], round(r["percent_rank"], 9), r["ntile"]) for r in got} == want


def test_more_tiles_than_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "p int")
    assert sorted((r["p"], r["ntile"]) for r in ordered.ranked(df, ["p"], tiles=5).collect()) == [(1, 1), (2, 2), (3, 3)]
    none = df.where("p > 9")
    assert ordered.ranked(none, ["p"]).collect() == [] == ordered.numbered(none, ["p"]).collect()
    assert ordered.cumulated(none, ["p"], {"s": "p"}).collect() == []


def test_rows_that_repeat_are_each_numbered(spark):
    got = ordered.numbered(spark.createDataFrame([(1, "a")] * 50 + [(None, "b")] * 3, "p int, q string"), ["p"]).collect()
    assert sorted(r["row_number"] for r in got) == list(range(1, 54)) and {r["row_number"] for r in got if r["p"] is None} == {1, 2, 3}


@pytest.mark.parametrize("name", sorted(ordered.QUERIES))
def test_no_task_gets_all_rows(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_hot_key_is_cut_to_ranges(spark):
    df = spark.range(40_000).selectExpr("if(id % 10 < 7, 0, id) as k", "id as t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ordered._sizes(ordered.placed(df, ["k", "t"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
