"""Tables laid out for what is asked of them: folders by column values, and buckets by key.

Folders: a filter or a join on the column skips whole folders, at run time too; a folder that is written again replaces
itself alone. Buckets: tables with the same number of buckets on the same key join, and aggregate by it, without a shuffle.
Rows are brought together before they are written, so the number of files doesn't grow with tasks times folders; a folder
with a large part of the rows is split between tasks (a rebalance, which adaptive execution sizes).

A null value of a folder column has a folder of its own and comes back as null. Empty tables can be written and read.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .scratch import remove


def write_folders(df: DataFrame, path: str, by: Sequence[str], append: bool = False) -> None:
    """Writes df to the table at path, a folder for each value of `by`. The folders that df has rows for replace what was
    there, all others stay; append: they are added to."""
    dealt = df.hint("rebalance", *by)
    out = dealt.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    out.parquet(path)


def read_folders(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def bucketed(df: DataFrame, path: str, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """df as a table at path of so many buckets of `key`, a sorted file for each. Bucketing is known to the catalog only, so
    the table has a name there; one that isn't given is dropped when the driver's Python exits."""
    spark = df.sparkSession
    if name is None:
        name = f"brindle_{uuid.uuid4().hex}"
        atexit.register(drop, spark, name, path)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").format("parquet").saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone already, and its catalog with it
        pass
    remove(spark, path)
