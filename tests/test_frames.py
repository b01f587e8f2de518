"""Functions over frames of whole groups."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from brindle.functions import frames
from brindle.plans import catalog


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_no_group_is_cut(size):
    rng = random.Random(size)
    rows = sorted(((rng.choice([-1, 1, 1, 1, 2, 3, 4]), rng.choice("ab"), i) for i in range(60)))
    df = pd.DataFrame([(None if k < 0 else k, t, i) for k, t, i in rows], columns=["k", "t", "i"])
    for keys in (["k"], ["k", "t"]):
        out = list(frames.whole_groups((df.iloc[a : a + size] for a in range(0, len(df), size)), keys))
        assert pd.concat(out)["i"].tolist() == df["i"].tolist()
        seen = [{tuple(map(str, r)) for r in f[keys].itertuples(index=False)} for f in out]
        assert sum(map(len, seen)) == len(set().union(*seen))
    assert list(frames.whole_groups(iter([df.iloc[:0]]), ["k"])) == []


def test_groups_share_calls(spark):
    """3,000 groups need not 3,000 calls; a null key is a group."""
    df = spark.range(9000).selectExpr("nullif(id % 3000, 0) as k", "id")

    def counted(rows):
        n = rows.groupby("k", dropna=False)["id"].transform("size")
        return pd.DataFrame({"id": rows["id"], "n": n, "call": [rows["id"].min()] * len(rows)})

    got = frames.apply(df, ["k"], counted, "id long, n long, call long").collect()
    assert len(got) == 9000 and {r["n"] for r in got} == {3} and len({r["call"] for r in got}) <= 20


def test_the_query_makes_no_call_for_each_group(spark, data):
    plan = catalog.QUERIES["grouped_frames"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInPandas" in plan
