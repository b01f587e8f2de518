"""The folder that the driver and all executors share, for what must outlive a lost executor."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder in /tmp where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/brindle-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(remove, spark, base)
    return base


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's Python exits."""
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; the folder is scratch
        pass


#: Bytes of a row group of a scratch table, which a writer holds in memory.
ROW_GROUP = 16 << 20


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs one stage.
    The table goes when the driver's Python exits, or with `discard`."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing still to be computed reads."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)
