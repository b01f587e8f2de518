"""Event-time streams: windows with watermarks, deduplication and custom state, each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import scratch_path
from ..sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The events as a stream of files. Watermarks need timestamps with a zone, so ts is cast."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, path: str | None = None) -> DataFrame:
    """All that a stream gives in append mode for the input that is there now, through a Parquet table in the shared folder.
    Its checkpoint stands beside it, so a stream that is stopped goes on, from the same path, without losing or repeating rows."""
    path = path or scratch_path(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def latest(stream: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key that a stream gives in update mode. Each batch is a folder of its own, written over if the
    batch is run again."""
    path, spark = scratch_path(stream.sparkSession), stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/table")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours by type."""
    grouped = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    grouped = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "15 minutes"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def counted_by_user(events: DataFrame) -> DataFrame:
    """Custom state: a running count and sum of each user over micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def gap_sessions(events: DataFrame) -> DataFrame:
    """Sessions of a user with gaps of thirty minutes."""
    grouped = events.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "30 minutes"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", "n", "first_id")


def once(events: DataFrame) -> DataFrame:
    """Events that may come again within an hour, each once."""
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def bought_after_click(events: DataFrame) -> DataFrame:
    """A join of two streams: purchases up to six hours after a click. The bounds on both times let old state go."""
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")).withWatermark("click_ts", "10 minutes")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts")).withWatermark("buy_ts", "10 minutes")
    return clicks.join(buys, F.expr("u = user_id and buy_ts >= click_ts and buy_ts <= click_ts + interval 6 hours")).select("user_id", "click_id", "buy_id")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(hourly(event_stream(spark, sf_dir)))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sliding(event_stream(spark, sf_dir)))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(gap_sessions(event_stream(spark, sf_dir)))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with every event twice."""
    return drained(once(event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir))))


def stream_clicks_then_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(bought_after_click(event_stream(spark, sf_dir)))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream that is stopped, and goes on with the first day's events a second time: all of them are
    later than the watermark and count no more."""
    path = scratch_path(spark)
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{path}/in")
    counted = hourly(spark.readStream.schema(events.schema).parquet(f"{path}/in"))
    drained(counted, path)
    first_day = events.where(F.col("ts") < events.agg(F.min("ts") + F.expr("interval 1 day")).scalar())
    first_day.write.mode("append").parquet(f"{path}/in")
    return drained(counted, path)


def stream_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(counted_by_user(event_stream(spark, sf_dir)), "user_id")


QUERIES = {f.__name__: f for f in (stream_hourly, stream_sliding, stream_sessions, stream_once, stream_clicks_then_purchases, stream_late, stream_user_totals)}
#: A window is given out when the watermark, ten minutes behind the latest event, has passed its end.
SQL = {
    "stream_hourly": """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
""",
    "stream_sliding": """
SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE,
  time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start FROM events)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY start
""",
    "stream_sessions": """
SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""",
    "stream_once": "SELECT event_id, user_id FROM events",
    "stream_clicks_then_purchases": """
SELECT a.user_id, a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click'
  AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
""",
    "stream_late": """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL
""",
    "stream_user_totals": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id",
}
