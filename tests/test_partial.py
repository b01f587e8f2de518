"""User aggregates with partial states against plain ones."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest

from brindle.functions import partial
from brindle.plans import catalog


def rows(rng, n):
    return [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "a", "b", "é"]), rng.choice([None, 0.0, 0.5, 3.0, 1000.0])) for _ in range(n)]


def groups(data, keys):
    out = {}
    for k, t, v in data:
        out.setdefault(tuple({"k": k, "t": t}[x] for x in keys), []).append(v)
    return {k: [v for v in vs if v is not None] for k, vs in out.items()}


@pytest.mark.parametrize("keys", [["k"], ["t", "k"], []])
def test_equal_plain_aggregates(spark, keys):
    data = rows(random.Random(len(keys)), 500)
    df = spark.createDataFrame([(*r, "x") for r in data], "k long, t string, v double, extra string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go over the ends of batches
    try:
        mean = {tuple(r)[:-1]: r["g"] for r in partial.aggregate(df, keys, ["v"], partial.GeometricMean(), "g").collect()}
        size = {tuple(r)[:-1]: r["m"] for r in partial.aggregate(df, keys, ["v"], partial.MiddleMagnitude(), "m").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = groups(data, keys)
    assert set(mean) == set(size) == set(want)
    for k, vs in want.items():
        assert mean[k] == pytest.approx(math.exp(statistics.fmean(map(math.log1p, vs))))
        buckets = sorted(math.frexp(v)[1] for v in vs)
        assert size[k] == buckets[(len(vs) + 1) // 2 - 1]


def test_nulls_only_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "k int, v double")
    got = partial.aggregate(df, ["k"], ["v"], partial.GeometricMean(), "g").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, None), (None, None)]
    for keys in (["k"], []):
        assert partial.aggregate(df.limit(0), keys, ["v"], partial.GeometricMean(), "g").collect() == []


def test_tasks_hand_on_states_and_stay_small(monkeypatch):
    agg = partial.GeometricMean()
    batch = pa.record_batch([pa.array([5] * 900 + list(range(100))), pa.array(np.arange(1000.0))], names=["k", "v"])
    out = list(partial._updates(1, agg)([batch] * 20))
    assert sum(b.num_rows for b in out) == 100  # 20,000 rows, one of whose keys has most
    monkeypatch.setattr(partial, "HELD", 60)
    assert sum(b.num_rows for b in partial._updates(1, agg)([batch] * 3)) == 300
    merged = pa.Table.from_batches(list(partial._finishes(1, agg)(pa.Table.from_batches(out).sort_by("k0").to_batches(max_chunksize=3))))
    assert merged["k0"].to_pylist() == list(range(100))


def test_keys_are_shuffled_as_states_only(spark, data):
    plan = catalog.QUERIES["grouped_user_function"](spark, data)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert plan.count("MapInArrow") == 2 and plan.index("MapInArrow") < exchange < plan.rindex("MapInArrow")
    assert "FlatMapGroups" not in plan and "AggregateInPandas" not in plan


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_array_states_are_shuffled_without_zeros_at_their_ends(kind):
    x = np.zeros((6, 64), kind)
    x[1, 0], x[2, 63], x[3, 10:14], x[4, :] = 3, 4, [1, 0, -2, 5], 7
    x[5, 20] = -0.0
    column = partial._lists(x, pa.from_numpy_dtype(kind))
    short = partial._trimmed(column)
    assert pa.compute.list_value_length(short).to_pylist()[:5] == [2, 3, 3, 6, 66]
    back = partial._to_numpy(partial._restored(short))
    assert back.dtype == kind and (back == x).all() and (np.signbit(back) == np.signbit(x)).all()
    assert (partial._to_numpy(partial._restored(short.slice(2, 3))) == x[2:5]).all()
    assert len(partial._restored(short.slice(0, 0))) == 0


def test_states_of_many_small_groups_take_few_bytes():
    """120,000 groups of one row: dense histograms are 61 MB, and no more than a part of them is held."""
    agg = partial.MiddleMagnitude()
    batches = [pa.record_batch([pa.array(np.arange(a, a + 10_000)), pa.array(np.full(10_000, 900.0))], names=["k", "v"]) for a in range(0, 120_000, 10_000)]
    out = list(partial._updates(1, agg)(iter(batches)))
    assert sum(b.num_rows for b in out) == 120_000 and sum(b.nbytes for b in out) < 6e6 and len(out) >= 4
    merged = pa.Table.from_batches(list(partial._finishes(1, agg)(pa.Table.from_batches(out).sort_by("k0").to_batches(max_chunksize=5000))))
    assert merged["k0"].to_pylist() == list(range(120_000)) and set(merged["result"].to_pylist()) == {10}
