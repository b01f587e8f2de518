"""Sketches that are stored a day at a time and merged to any span, without the rows behind them.

A day's state of a group is a few kB: HyperLogLog (`LOG_K` registers) for distinct counts, theta (the same size) for unions,
intersections and differences of sets, KLL (`RANK_K`) for quantiles. They are written in one folder a day; a day that is
computed again replaces its folder alone. A span reads its days' states and merges them, so its cost is in proportion to days,
not rows.

Errors, as three standard ones: `HLL_ERROR` and `THETA_ERROR` of the count (of the union's, for intersections and
differences), `RANK_ERROR` of the rank of a quantile. Nulls count nowhere, as in exact aggregates; rows without a time are of
no day. Values that repeat count once in sets and each in ranks. A span without days has no row; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..sources.tables import table
from .registry import Registry

LOG_K = 12
RANK_K = 200

HLL_ERROR = 3 * 1.04 / 2 ** (LOG_K / 2)
THETA_ERROR = 3 / (2**LOG_K - 1) ** 0.5
RANK_ERROR = 3 * 0.0133

_queries = Registry()


def states(df: DataFrame, time: str, by: Sequence[str] = (), distinct: Mapping[str, str] | None = None, ranks: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each day and group: n (rows), <name>_hll and <name>_theta of each distinct column, <name>_kll of each ranked
    one. distinct, ranks: name -> column. Partial states are merged in the tasks before the shuffle."""
    aggregates = [F.count("*").alias("n")]
    for name, column in (distinct or {}).items():
        aggregates += [F.hll_sketch_agg(column, LOG_K).alias(f"{name}_hll"), F.theta_sketch_agg(column, LOG_K).alias(f"{name}_theta")]
    for name, column in (ranks or {}).items():
        aggregates.append(F.kll_sketch_agg_double(column, RANK_K).alias(f"{name}_kll"))
    return df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day"), *by).agg(*aggregates)


def store(found: DataFrame, path: str) -> None:
    """Writes states to the table at path; the days in them replace what is there of these days."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(found: DataFrame, spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of spans (columns span, low, high: closed ranges of days), a row for each span and group."""
    days = spans.select("span", F.explode(F.sequence("low", "high")).alias("day"))
    aggregates = [F.sum("n").alias("n")]
    for c in found.columns:
        if c.endswith("_hll"):
            aggregates.append(F.hll_union_agg(c).alias(c))
        elif c.endswith("_theta"):
            aggregates.append(F.theta_union_agg(c, LOG_K).alias(c))
        elif c.endswith("_kll"):
            aggregates.append(F.kll_merge_agg_double(c, RANK_K).alias(c))
    return found.join(days, "day").groupBy("span", *by).agg(*aggregates)


def distinct_count(name: str) -> Column:
    return F.hll_sketch_estimate(f"{name}_hll")


def in_both(a: Column | str, b: Column | str) -> Column:
    """How many values two theta states have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_in(a: Column | str, b: Column | str) -> Column:
    """How many values the first of two theta states has alone."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(name: str, part: float) -> Column:
    return F.kll_sketch_get_quantile_double(f"{name}_kll", F.lit(part))


def close(estimate: Column, exact: Column, error: float, of: Column | None = None) -> Column:
    """Whether an estimate is within its error (relative to `of`), or within one of small counts."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), error * (exact if of is None else of))


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events, and their stored states by day."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "value", F.to_date("ts").alias("day"))
    path = scratch_path(spark)
    store(states(events, "ts", distinct={"users": "user_id"}, ranks={"value": "value"}), path)
    return events, stored(spark, path)


@_queries.query("""
WITH spans AS (SELECT DISTINCT CAST(ts AS DATE) AS span FROM events)
SELECT span, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, true AS users_close, true AS median_close, true AS ninth_close
FROM spans JOIN events ON CAST(ts AS DATE) BETWEEN span - 6 AND span GROUP BY span
""")
def users_of_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the week up to each day, merged from days: users and quantiles of values. The exact count stands beside the
    sketches, which only say whether they are within their errors of it."""
    events, daily = _daily(spark, sf_dir)
    spans = daily.select(F.col("day").alias("span"), F.date_sub("day", 6).alias("low"), F.col("day").alias("high"))
    sketched = merged(daily, spans).select("span", distinct_count("users").alias("estimate"), quantile("value", 0.5).alias("median"), quantile("value", 0.9).alias("ninth"))
    of_span = events.join(spans.select("span", F.explode(F.sequence("low", "high")).alias("day")), "day").join(sketched, "span")
    exact = of_span.groupBy("span").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.first("estimate").alias("estimate"),
        F.avg((F.col("value") <= F.col("median")).cast("int")).alias("at_median"), F.avg((F.col("value") <= F.col("ninth")).cast("int")).alias("at_ninth"),
    )
    rank = lambda c, part: F.abs(F.col(c) - part) <= RANK_ERROR
    return exact.select("span", "n", "users", close(F.col("estimate"), F.col("users"), HLL_ERROR).alias("users_close"), rank("at_median", 0.5).alias("median_close"), rank("at_ninth", 0.9).alias("ninth_close"))


@_queries.query("""
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events)
SELECT a.day, CAST(count(b.user_id) AS BIGINT) AS stayed, CAST(count(*) - count(b.user_id) AS BIGINT) AS came, true AS stayed_close, true AS came_close
FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.day = a.day - 1 GROUP BY a.day
HAVING a.day > (SELECT min(day) FROM d)
""")
def returning_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day but the first, users who were there the day before and who were not, by set operations on states."""
    events, daily = _daily(spark, sf_dir)
    own = daily.select("day", "users_theta")
    before = own.select(F.date_add("day", 1).alias("day"), F.col("users_theta").alias("before"))
    sketched = own.join(before, "day").select("day", in_both("users_theta", "before").alias("in_both"), only_in("users_theta", "before").alias("only_in"))
    pairs = events.select("day", "user_id").distinct()
    seen = pairs.select(F.date_add("day", 1).alias("day"), "user_id", F.lit(1).alias("seen"))
    exact = pairs.join(seen, ["day", "user_id"], "left").groupBy("day").agg(F.count("seen").alias("stayed"), F.count_if(F.col("seen").isNull()).alias("came"))
    both = F.col("stayed") + F.col("came")
    return exact.join(sketched, "day").select(
        "day", "stayed", "came", close(F.col("in_both"), F.col("stayed"), 2 * THETA_ERROR, both).alias("stayed_close"), close(F.col("only_in"), F.col("came"), 2 * THETA_ERROR, both).alias("came_close")
    )


QUERIES, SQL = _queries.queries, _queries.sql
