"""Reading tables."""

from __future__ import annotations

from brindle.sources import scratch
from brindle.sources.tables import SCHEMAS, TABLES, register, table


def test_given_schemas_are_the_files(spark, data):
    for name in SCHEMAS:
        assert [(f.name, f.dataType) for f in table(spark, data, name).schema] == [(f.name, f.dataType) for f in spark.read.parquet(f"{data}/{name}.parquet").schema]


def test_views_of_all_tables(spark, data):
    register(spark, data)
    assert all(spark.table(name).limit(1).count() == 1 for name in TABLES)


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = table(spark, data, "lineitem").where("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_scratch_paths_are_shared_and_removed(spark):
    path = scratch.scratch_path(spark)
    assert path.startswith(scratch.shared_dir(spark))
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    scratch.remove(spark, path)
    scratch.remove(spark, path)  # once more does no harm
