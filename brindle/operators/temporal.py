"""Joins on time: intervals and as-of, without cross products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key where the right time lies in [left time, left time + seconds].

    An equi-join on (key, bucket of `seconds`), each left row looking into two buckets, so a key's rows are spread over
    its buckets instead of meeting in one task."""
    wide = left.withColumn("__bucket", F.explode(F.array(_bucket(left_time, seconds), _bucket(left_time, seconds) + 1)))
    joined = wide.join(right.withColumn("__bucket", _bucket(right_time, seconds)), [key, "__bucket"])
    return joined.where((F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {seconds} seconds"))).drop("__bucket")


DAY = 86_400


def _bucket(time: str, seconds: int):
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, alias: str, seconds: int = DAY) -> DataFrame:
    """left with the latest right value of its key at or before its time (of equal times the greatest value; null values
    don't count); left rows without one are dropped.

    A key's rows are cut to buckets of `seconds`, each sorted alone. What a bucket takes over from those before it comes
    from one row for each key and bucket, so a key with a large share of the rows doesn't end in one task."""
    both = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value")).unionByName(
        right.where(F.col(value).isNotNull()).select(key, time, F.lit(0).alias("__side"), F.col(value).alias("__value")), allowMissingColumns=True
    )
    both = both.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("__bucket", _bucket(time, seconds))
    ends = both.groupBy(F.col(key).alias("__key"), "__bucket").agg(F.max_by("__value", F.when(F.col("__side") == 0, F.struct(time, "__value"))).alias("__end"))
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy(key, "__bucket").orderBy(time, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.last("__value", ignorenulls=True).over(within)).where("__side = 1")
    out = found.join(carried.select("__key", F.col("__bucket").alias("__b"), "__carried"), (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b")))
    return out.withColumn(alias, F.coalesce("__own", "__carried")).where(F.col(alias).isNotNull()).drop("__side", "__value", "__bucket", "__own", "__key", "__b", "__carried")


def sessionized(events: DataFrame, key: str, time: str, order: str, gap: int, seconds: int = DAY) -> DataFrame:
    """events with `session`: the number, from 1, of its key's run of events with gaps of at most `gap` seconds.

    As above, a key is cut to buckets; the last time and the number of sessions begun in the buckets before are carried
    over from one row for each key and bucket."""
    cut = events.withColumn("__bucket", _bucket(time, seconds))
    within = Window.partitionBy(key, "__bucket").orderBy(time, order)
    by = Window.partitionBy("__key").orderBy("__b")
    far = lambda now, before: F.coalesce(now > before + F.expr(f"interval {gap} seconds"), F.lit(True))
    own = cut.withColumn("__new", far(F.col(time), F.lag(time).over(within)))  # a bucket's first row counts as new here
    edges = own.groupBy(F.col(key).alias("__key"), F.col("__bucket").alias("__b")).agg(F.min(time).alias("__first"), F.max(time).alias("__last"), F.count_if("__new").alias("__n"))
    edges = edges.withColumn("__joins", ~far(F.col("__first"), F.lag("__last").over(by)))
    edges = edges.withColumn("__before", F.coalesce(F.sum(F.col("__n") - F.col("__joins").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.withColumn("__own", F.sum(F.col("__new").cast("int")).over(within))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__b"))
    out = numbered.join(edges.select("__key", "__b", "__joins", "__before"), same)
    return out.withColumn("session", F.col("__before") + F.col("__own") - F.col("__joins").cast("int")).drop("__bucket", "__new", "__own", "__key", "__b", "__joins", "__before")


def clicks_then_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    return interval_join(clicks, buys, "user_id", "click_ts", "buy_ts", 6 * 3600).select("user_id", "click_id", "buy_id")


def purchase_before_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return asof_join(clicks, events.where("event_type = 'purchase'"), "user_id", "ts", "value", "last_purchase").select("user_id", "event_id", "last_purchase")


QUERIES = {f.__name__: f for f in (clicks_then_purchases, purchase_before_click)}
SQL = {
    "clicks_then_purchases": """
SELECT a.user_id, a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click'
  AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
""",
    "purchase_before_click": """
SELECT c.user_id, c.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
  ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts
""",
}
