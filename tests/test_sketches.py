"""Stored sketches: errors on many values, merging, replaced days, nulls and empty tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import sketches
from brindle.plans import catalog

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """200,000 rows over ten days; day d has the users 5,000 d to 5,000 d + 20,000, so days overlap."""
    day = (F.col("id") % 10).cast("int")
    return spark.range(200_000).select(
        (F.lit(DAY).cast("timestamp") + F.make_interval(days=day)).alias("ts"), (5000 * day + F.floor(F.col("id") / 10)).alias("user"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("value"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
    )


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sketches") / "daily")
    sketches.store(sketches.states(rows, "ts", ["kind"], {"users": "user"}, {"value": "value"}), out)
    return out


def spans(spark, *ranges):
    return spark.createDataFrame([(f"{a}-{b}", DAY + dt.timedelta(a), DAY + dt.timedelta(b)) for a, b in ranges], "span string, low date, high date")


def test_merged_spans_are_within_their_errors(spark, rows, path):
    daily = sketches.stored(spark, path)
    got = sketches.merged(daily, spans(spark, (0, 0), (0, 9), (2, 5))).select("span", "n", sketches.distinct_count("users").alias("users"), F.theta_sketch_estimate("users_theta").alias("theta"), sketches.quantile("value", 0.25).alias("q")).collect()
    want = {"0-0": (20_000, 20_000), "0-9": (200_000, 65_000), "2-5": (80_000, 35_000)}
    assert {r["span"]: r["n"] for r in got} == {k: n for k, (n, _) in want.items()}
    for r in got:
        users = want[r["span"]][1]
        assert abs(r["users"] - users) <= sketches.HLL_ERROR * users and abs(r["theta"] - users) <= sketches.THETA_ERROR * users
        assert abs(r["q"] / 100_000 - 0.25) <= sketches.RANK_ERROR + 0.01


def test_groups_and_set_operations(spark, path):
    by_kind = sketches.merged(sketches.stored(spark, path), spans(spark, (0, 9)), ["kind"]).collect()
    assert sorted(r["kind"] for r in by_kind) == ["a", "b"] and sum(r["n"] for r in by_kind) == 200_000
    days = sketches.merged(sketches.stored(spark, path), spans(spark, (1, 1), (2, 2), (9, 9)))
    pair = {r["span"]: r["users_theta"] for r in days.collect()}
    both = spark.createDataFrame([(pair["1-1"], pair["2-2"], pair["9-9"])], "a binary, b binary, c binary").select(
        sketches.in_both("a", "b").alias("both"), sketches.only_in("a", "b").alias("only"), sketches.in_both("a", "c").alias("none")
    ).first()
    assert abs(both["both"] - 15_000) <= 25_000 * sketches.THETA_ERROR * 2 and abs(both["only"] - 5000) <= 25_000 * sketches.THETA_ERROR * 2 and both["none"] == 0


def test_a_day_computed_again_replaces_itself_alone(spark, tmp_path):
    out = str(tmp_path / "daily")
    rows = lambda *of: spark.createDataFrame([(dt.datetime(2024, 1, d), u, v) for d, u, v in of], "ts timestamp, user long, value double")
    keep = lambda df: sketches.store(sketches.states(df, "ts", (), {"users": "user"}, {"value": "value"}), out)
    keep(rows((1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0)))
    keep(rows((2, 5, 1.0), (2, 6, 1.0), (2, None, None), (2, 6, 4.0)))
    got = sketches.stored(spark, out).select(F.dayofmonth("day").alias("d"), "n", sketches.distinct_count("users").alias("users")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2), (2, 4, 2)]


def test_no_time_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1)], "ts timestamp, user long")
    found = sketches.states(df, "ts", (), {"users": "user"})
    assert found.collect() == [] and sketches.merged(found, spans(spark, (0, 3))).collect() == []


@pytest.mark.parametrize("name", sorted(sketches.QUERIES))
def test_days_are_merged_from_states(spark, data, name):
    rows = catalog.QUERIES[name](spark, data).collect()
    assert rows and all(r[c] for r in rows for c in r.asDict() if c.endswith("_close"))


def test_states_are_merged_before_the_shuffle(spark, rows):
    plan = sketches.states(rows, "ts", (), {"users": "user"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and "partial_theta_sketch_agg" in plan
