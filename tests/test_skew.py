"""The skew join against Spark's own join, its sketch, and what one task gets."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import skew
from brindle.plans import catalog


def sides(spark, rng, hot):
    """Zipf-like keys on both sides, hot ones that one side lacks, nulls, and rows that repeat."""
    keys = [None, *[7] * hot, *[8] * (hot // 2), *range(40)]
    a = [(rng.choice(keys), rng.choice("xy"), i) for i in range(300)] + [(900, "x", 1)] * 60
    b = [(rng.choice(keys), rng.choice("xy"), j) for j in range(120)] + [(800, "y", 2)] * 40
    return spark.createDataFrame(a, "k int, t string, i int").repartition(3), spark.createDataFrame(b, "k2 int, t2 string, j int").repartition(2)


@pytest.mark.parametrize(("how", "hot"), [*((how, 60) for how in skew.KINDS), ("full", 0)])
def test_equals_the_plain_join(spark, how, hot):
    left, right = sides(spark, random.Random(hot), hot)
    for on in ([("k", "k2")], [("k", "k2"), ("t", "t2")]):
        want = left.join(right, [F.col(a) == F.col(b) for a, b in on], how)
        got = skew.skew_join(left, right, on, how, share=0.05, cell=20)
        assert got.columns == want.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["full", "left_anti"])
def test_empty_sides(spark, how):
    left, right = sides(spark, random.Random(1), 50)
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        want = a.join(b, F.col("k") == F.col("k2"), how)
        assert Counter(map(tuple, skew.skew_join(a, b, [("k", "k2")], how, share=0.1).collect())) == Counter(map(tuple, want.collect()))


def test_heavy_keys_are_all_found_and_exact(spark):
    rng = random.Random(5)
    values = [int(1 / (1 - rng.random()) ** 1.2) for _ in range(6000)] + [None] * 4000
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(6)
    n = Counter(v for v in values if v is not None)
    code = {r["k"]: r["h"] for r in df.distinct().select("k", F.xxhash64("k").alias("h")).collect()}
    for share in (0.3, 0.02, 0.005):
        assert skew.heavy_keys(df, ["k"], share) == {code[k]: c for k, c in n.items() if c > share * 6000}
    assert skew.heavy_keys(spark.range(5000), ["id"], 0.01) == {}


def test_no_task_gets_a_hot_key(spark):
    """A key with 60 % of 20,000 rows meets one with 5,000 rows: cells of 500 rows, dealt evenly."""
    left = spark.range(20_000).select(F.when(F.col("id") % 10 < 6, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    right = spark.range(4000).select(F.when(F.col("id") < 25, 0).otherwise(F.col("id") + 3).alias("k2"), F.col("id").alias("j"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        joined = skew.skew_join(left, right, [("k", "k2")], share=0.005, cell=500)
        sizes = Counter(r[0] for r in joined.where("k = 0").select(F.spark_partition_id()).collect())
        plain = Counter(r[0] for r in left.join(right, F.col("k") == F.col("k2")).where("k = 0").select(F.spark_partition_id()).collect())
    finally:
        for key, value in (("spark.sql.autoBroadcastJoinThreshold", None), ("spark.sql.adaptive.enabled", None), ("spark.sql.shuffle.partitions", "4")):
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    total = 12_000 * 25
    assert sum(sizes.values()) == total == max(plain.values())  # plainly, one task makes all of them
    assert len(sizes) > 10 and max(sizes.values()) <= 0.25 * total


def test_misuse_is_refused(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,)], "k2 long")
    for args, what in (((a, b, [("k", "k2")]), "unlike"), ((a, a, [("k", "k")]), "both"), ((a, b, [("k", "k2")], "cross"), "one of")):
        with pytest.raises(ValueError, match=what):
            skew.skew_join(*args)


@pytest.mark.parametrize("name", sorted(skew.QUERIES))
def test_plans_are_equi_joins(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "__skew_i" in plan


def test_copies_are_not_broadcast_and_grow_with_the_rows(spark):
    """Two small tables with one key: what is joined are their copies, whose size Spark doesn't know."""
    left = spark.range(600).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    right = spark.range(400).select(F.lit(1).alias("k2"), F.col("id").alias("j"))
    joined = skew.skew_join(left, right, [("k", "k2")], cell=10)
    grids = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "__skew_i" in line]
    assert grids and all("SortMergeJoin" in line for line in grids)
    assert joined.count() == 240_000
    for n in (10, 1000, 100_000):
        columns, rows = skew.grid(36 * n, 3 * n, 2)
        assert 36 * n * rows + 3 * n * columns <= 12 * skew.CELLS**0.5 * 3 * n and columns * rows <= 1.2 * skew.CELLS
    assert skew.grid(5000, 900, 1000) == (5, 1) and skew.grid(0, 7, 2) == (1, 4) and skew.grid(10_000, 1, 1) == (10_000, 1)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_packs_equal_the_plain_join(spark, monkeypatch, how):
    """Packs of 4 rows in so many tasks that Spark doesn't choose their number: rows that repeat, nulls and two keys, once each."""
    monkeypatch.setattr(skew, "PACK", 4)
    monkeypatch.setattr(skew, "PAIRS", 300)
    left, right = sides(spark, random.Random(3), 90)
    left, right = left.withColumn("t", F.ascii("t")), right.withColumn("t2", F.ascii("t2"))
    for on in ([("k", "k2")], [("k", "k2"), ("t", "t2")]):
        want = left.join(right, [F.col(a) == F.col(b) for a, b in on], how)
        got = skew.skew_join(left, right, on, how, share=0.05, cell=20)
        assert "collect_list" in got._jdf.queryExecution().executedPlan().toString()
        assert got.dtypes == want.dtypes and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    wide = skew.skew_join(left.withColumn("w", F.lit("w")), right, [("k", "k2")], how, share=0.05, cell=20)
    assert "collect_list" not in wide._jdf.queryExecution().executedPlan().toString()  # its pairs could be of any size


def test_files_of_many_pairs_stay_small(spark, tmp_path):
    """4,000,000 pairs of one key: files that go through a whole cell for each row take about a byte a pair."""
    left = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") * 7919).alias("i"))
    right = spark.range(8000).select(F.lit(1).alias("k2"), (F.col("id") * 104_729).alias("j"))
    skew.skew_join(left, right, [("k", "k2")]).select("i", "j").write.option("compression", "snappy").parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert (back.count(), back.distinct().count()) == (4_000_000, 4_000_000)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * 4_000_000


def test_tasks_follow_the_pairs(spark, monkeypatch):
    """Few bytes, many pairs: as many tasks as the pairs ask for, which Spark doesn't put together."""
    monkeypatch.setattr(skew, "PAIRS", 20_000)
    left = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    right = spark.range(1000).select(F.lit(1).alias("k2"), F.col("id").alias("j"))
    sizes = Counter(r[0] for r in skew.skew_join(left, right, [("k", "k2")], cell=50).select(F.spark_partition_id()).collect())
    assert sum(sizes.values()) == 1_000_000 and len(sizes) > 25 and max(sizes.values()) < 200_000
