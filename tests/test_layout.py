"""Folders and buckets: what is replaced, what is read, what isn't shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.plans import catalog
from brindle.sources import layout


def test_folders_replace_themselves_alone(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "v int, k string"
    rows = lambda *of: spark.createDataFrame(list(of), kind)
    layout.write_folders(rows((1, "a"), (2, "b"), (3, None)), path, ["k"])
    layout.write_folders(rows((4, "b"), (5, "c")), path, ["k"])
    read = lambda: sorted(map(tuple, layout.read_folders(spark, path, kind).collect()), key=repr)
    assert read() == [(1, "a"), (3, None), (4, "b"), (5, "c")]
    layout.write_folders(rows((6, "a"), (7, None)), path, ["k"], append=True)
    assert read() == [(1, "a"), (3, None), (4, "b"), (5, "c"), (6, "a"), (7, None)]
    layout.write_folders(rows().limit(0), path, ["k"])
    assert len(read()) == 6


def test_filters_skip_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.write_folders(spark.range(1000).selectExpr("id", "int(id % 10) as k"), path, ["k"])
    some = layout.read_folders(spark, path).where("k = 3")
    assert some.count() == 100 and len(some.inputFiles()) >= 1
    assert {f.split("k=")[1][0] for f in map(str, some.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])} == {"3"}
    assert "PartitionFilters: [isnotnull(k" in some._jdf.queryExecution().executedPlan().toString()


def test_few_files_a_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.write_folders(spark.range(2000).repartition(16).selectExpr("id", "int(id % 5) as k"), path, ["k"])
    assert len(layout.read_folders(spark, path).inputFiles()) <= 2 * 5


def test_joins_prune_folders_at_run_time(spark, data):
    plan = catalog.QUERIES["lines_of_busy_years"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_buckets_join_without_a_shuffle(spark, data):
    got = catalog.QUERIES["bucketed_orders"](spark, data)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_empty_and_null_keys_in_buckets(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (5, 2), (5, 3)], "k int, v int")
    assert sorted(map(tuple, layout.bucketed(df, str(tmp_path / "a"), "k", 3).collect()), key=repr) == [(5, 2), (5, 3), (None, 1)]
    assert layout.bucketed(df.limit(0), str(tmp_path / "b"), "k", 3).collect() == []


@pytest.mark.parametrize("again", [1, 2])
def test_a_name_can_be_written_again(spark, tmp_path, again):
    for n in range(again):
        layout.bucketed(spark.range(10 + n), str(tmp_path / "named"), "id", 2, "brindle_named")
    assert spark.table("brindle_named").count() == 9 + again
    layout.drop(spark, "brindle_named", str(tmp_path / "named"))
    assert not spark.catalog.tableExists("brindle_named")
