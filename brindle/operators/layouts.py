"""Queries over tables that were laid out for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout import bucketed, read_folders, write_folders
from ..sources.scratch import scratch_path
from ..sources.tables import table
from .registry import Registry

_queries = Registry()


@_queries.query("""
WITH busy AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') > (SELECT count(*) FILTER (o_orderstatus = 'P') / 7.0 FROM orders))
SELECT year, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN busy ON CAST(year(l_shipdate) AS INTEGER) = year GROUP BY ALL
""")
def lines_of_busy_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in folders by year of shipping, joined with the years that have many pending orders: only these years' folders
    are read (dynamic partition pruning)."""
    path = scratch_path(spark)
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"))
    write_folders(lines, path, ["year"])
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "P").cast("int").alias("pending"))
    least = orders.agg((F.sum("pending") / 7.0).alias("least")).scalar()
    busy = orders.groupBy("year").agg(F.sum("pending").alias("pending")).where(F.col("pending") > least).select("year")
    found = read_folders(spark, path, "l_returnflag string, quantity bigint, year int")
    return found.join(busy, "year").groupBy("year", "l_returnflag").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@_queries.query("""
SELECT o_orderkey, o_custkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey
""")
def bucketed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines in buckets of the order key: joined and summed without a shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), scratch_path(spark), "o_orderkey", n)
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("quantity")), scratch_path(spark), "l_orderkey", n)
    joined = orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


QUERIES, SQL = _queries.queries, _queries.sql
