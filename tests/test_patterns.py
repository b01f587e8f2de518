"""Event patterns against a plain automaton."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from brindle.operators import patterns

START = dt.datetime(2024, 1, 1)


def plain(rows, steps, within):
    """One pass over a key's events in order; states hold the latest event that reached them."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        states = [None] * len(steps)
        own = sorted((r for r in rows if r[0] == key and r[1] is not None and r[3] is not None), key=lambda r: (r[1], steps.index(r[3]) if r[3] in steps else -1, r[2]))
        for _, at, i, kind in own:
            for k in reversed(range(len(steps))):
                if kind != steps[k]:
                    continue
                if k == 0:
                    states[0] = (at, [i])
                    out += [(key, at, [i])] if len(steps) == 1 else []
                elif states[k - 1] and (at - states[k - 1][0]).total_seconds() <= within:
                    states[k] = (at, [*states[k - 1][1], i])
                    if k == len(steps) - 1:
                        out.append((key, at, states[k][1]))
    return sorted(out)


@pytest.mark.parametrize("bucket", [300, 86_400])
@pytest.mark.parametrize("steps", [["a", "b", "c"], ["a", "b"], ["b"]])
def test_equals_a_plain_automaton(spark, steps, bucket):
    """Distinct kinds with many equal times, nulls, and keys of all sizes."""
    rng = random.Random(len(steps))
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *[START + dt.timedelta(seconds=60 * rng.randrange(90))] * 9]), i, rng.choice([None, "a", "b", "c", "x"])) for i in range(250)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, i int, kind string").repartition(3)
    got = patterns.sequences(df, "k", "ts", "i", "kind", steps, 600, bucket).collect()
    assert sorted((r["k"], r["ts"], r["path"]) for r in got) == plain(rows, steps, 600)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, ts timestamp, i int, kind string")
    assert patterns.sequences(df, "k", "ts", "i", "kind", ["a", "b"], 60).collect() == []


def test_a_step_cannot_follow_itself(spark):
    df = spark.createDataFrame([], "k int, ts timestamp, i int, kind string")
    with pytest.raises(ValueError, match="itself"):
        patterns.sequences(df, "k", "ts", "i", "kind", ["a", "a"], 60)
