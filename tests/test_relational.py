"""How joins of one table with itself are dealt to tasks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from brindle.operators import relational
from brindle.sources.tables import SCHEMAS


def test_twins_of_one_brand_and_size_are_dealt_to_tasks(spark, tmp_path):
    """400 parts with 100 prices, all of one brand and size and in one file: no task makes most of the pairs."""
    rows = [(i, "p", "b", "t", 5, float(i % 100)) for i in range(400)] + [(900, "p", None, "t", 5, 1.0), (901, "p", "b", "t", 5, None)]
    spark.createDataFrame(rows, SCHEMAS["part"]).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = relational.dearer_twins(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    want = Counter((a[0], b[0]) for a in rows[:400] for b in rows[:400] if a[5] < b[5])
    assert Counter((r["cheap"], r["dear"]) for r in pairs) == want
    tasks = Counter(r["task"] for r in pairs)
    assert len(tasks) > 2 and max(tasks.values()) < 0.6 * len(pairs)
