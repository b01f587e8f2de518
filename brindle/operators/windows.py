"""Window functions: ranking, offsets and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import register, table
from .temporal import sessionized


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    loose = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(by).alias("rn"), F.rank().over(loose).alias("rk"), F.dense_rank().over(loose).alias("dr"), F.ntile(3).over(by).alias("third"), F.round(F.percent_rank().over(by), 8).alias("pr")
    )


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner limits each group before the shuffle (WindowGroupLimit)."""
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("rn")).where("rn <= 3")


def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("event_id").over(by).alias("before"), F.lead("event_type", 1, "none").over(by).alias("after"),
        F.first("event_id").over(whole).alias("first_id"), F.nth_value("event_id", 2).over(whole).alias("second_id"), F.last("event_id").over(whole).alias("last_id"),
    )


def running_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "events")
    return spark.sql("""
        SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS last5,
          count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n
        FROM events""")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps of at most thirty minutes."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    numbered = sessionized(events, "user_id", "ts", "event_id", 30 * 60)
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (order_ranks, top_orders_per_customer, event_neighbours, running_values, sessions)}
SQL = {
    "order_ranks": """
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER v AS INTEGER) AS rk, CAST(dense_rank() OVER v AS INTEGER) AS dr,
  CAST(ntile(3) OVER w AS INTEGER) AS third, round(percent_rank() OVER w, 8) AS pr
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""",
    "top_orders_per_customer": """
SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 3
""",
    "event_neighbours": """
SELECT event_id, lag(event_id) OVER w AS before, lead(event_type, 1, 'none') OVER w AS after, first_value(event_id) OVER f AS first_id,
  nth_value(event_id, 2) OVER f AS second_id, last_value(event_id) OVER f AS last_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
    "running_values": """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS last5,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM events
""",
    "sessions": """
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events))
GROUP BY 1, 2
""",
}
