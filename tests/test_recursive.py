"""Fixpoints against a plain search, with cycles, nulls and long chains."""

from __future__ import annotations

import collections
import random

import pytest

from brindle.operators import recursive


def search(edges, seeds, most=None):
    out = {}
    ways = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            ways[a].add(b)
    for source in {s for s, n in seeds if s is not None and n is not None}:
        depth = {n: 0 for s, n in seeds if s == source and n is not None}
        queue = collections.deque(depth)
        while queue:
            at = queue.popleft()
            if most is None or depth[at] < most:
                for b in ways[at]:
                    if b not in depth:
                        depth[b] = depth[at] + 1
                        queue.append(b)
        out |= {(source, n): d for n, d in depth.items()}
    return out


@pytest.mark.parametrize("most", [None, 2])
def test_equals_a_plain_search(spark, most):
    rng = random.Random(4)
    edges = [(rng.choice([None, *range(60)]), rng.choice([None, *range(60)])) for _ in range(75)] + [(i, i + 1) for i in range(100, 114)] + [(114, 100), (5, 5)] * 2
    seeds = [(rng.choice("xyz"), rng.randrange(60)) for _ in range(4)] + [("x", 100), ("x", 100), ("w", 999), (None, 3), ("v", None)]
    got = recursive.reachable(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame(seeds, "source string, node int"), most)
    rows = got.collect()
    assert {(r["source"], r["node"]): r["depth"] for r in rows} == search(edges, seeds, most) and got.columns == ["source", "node", "depth"]
    assert len(rows) == len({(r["source"], r["node"]) for r in rows})


def test_empty_sides(spark):
    edges, seeds = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([("s", 1)], "source string, node int")
    assert recursive.reachable(edges, seeds.limit(0)).collect() == []
    assert [tuple(r) for r in recursive.reachable(edges.limit(0), seeds).collect()] == [("s", 1, 0)]


def test_plans_stay_small(spark):
    chain = spark.range(12).selectExpr("id as a", "id + 1 as b")
    got = recursive.reachable(chain, spark.createDataFrame([(0, 0)], "source long, node long"))
    assert sorted(r["depth"] for r in got.collect()) == list(range(13))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= recursive.APART and "Join" not in plan
