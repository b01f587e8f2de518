"""Patterns over a key's ordered events: a sequence of kinds, each within a time of the one before.

An automaton whose state k is "the first k steps have happened" only needs, for each state, the latest event that reached it:
a later one leaves more time for the next step. So step k + 1 is an as-of lookup of the latest event in state k, kept where it
is near enough. Each lookup cuts a key to buckets of time and carries one row a bucket over (see `asof_join`), so a key with
a large part of the events isn't one task, and a pattern of n steps is n - 1 lookups whatever the length of the history.

Times may be equal: a step at the time of the one before follows it. Of events of one kind and time the one with the greatest
`order` is taken. Null keys, times and kinds match nothing. Events that repeat are each an end. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import Registry
from .temporal import DAY, asof_join

_queries = Registry()


def reached(events: DataFrame, key: str, time: str, order: str, kind: str, steps: Sequence[str], within: int, bucket: int = DAY) -> list[DataFrame]:
    """For each step, the events that reach it: key, time and `path`, the array of `order` of the steps so far."""
    if any(a == b for a, b in zip(steps, steps[1:])):
        raise ValueError("a step can't follow itself: an event would be both")
    rows = events.select(key, time, order, kind).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    of = lambda step: rows.where(F.col(kind) == step)
    out = [of(steps[0]).select(key, time, F.array(order).alias("path"))]
    for step in steps[1:]:
        before = out[-1].select(key, time, F.struct(F.col(time).alias("at"), F.element_at("path", -1).alias("last"), "path").alias("state"))
        found = asof_join(of(step).select(key, time, order), before, key, time, "state", "state", bucket)
        near = found.where(F.col(time) <= F.col("state.at") + F.expr(f"interval {within} seconds"))
        out.append(near.select(key, time, F.concat("state.path", F.array(order)).alias("path")))
    return out


def sequences(events: DataFrame, key: str, time: str, order: str, kind: str, steps: Sequence[str], within: int, bucket: int = DAY) -> DataFrame:
    """The events that complete all steps: key, time and path."""
    return reached(events, key, time, order, kind, steps, within, bucket)[-1]


_EVENTS = "SELECT CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE user_id % 7 END AS k, ts, event_id, event_type FROM events"
_STEP = "SELECT b.k, b.ts, {ids}, b.event_id AS e{n} FROM (SELECT * FROM e WHERE event_type = '{kind}') b ASOF JOIN {before} a ON a.k = b.k AND b.ts >= a.ts WHERE b.ts <= a.ts + INTERVAL 2 HOUR"


@_queries.query(f"""
WITH e AS (SELECT user_id AS k, * FROM events), s1 AS (SELECT k, ts, event_id AS e1 FROM e WHERE event_type = 'view'),
s2 AS ({_STEP.format(ids="a.e1", n=2, kind="click", before="s1").replace("2 HOUR", "1 DAY")}), s3 AS ({_STEP.format(ids="a.e1, a.e2", n=3, kind="purchase", before="s2").replace("2 HOUR", "1 DAY")})
SELECT k AS user_id, e1 AS view_id, e2 AS click_id, e3 AS purchase_id FROM s3
""")
def view_click_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases after a click after a view, each within a day."""
    found = sequences(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", ["view", "click", "purchase"], DAY)
    return found.select("user_id", F.col("path")[0].alias("view_id"), F.col("path")[1].alias("click_id"), F.col("path")[2].alias("purchase_id"))


@_queries.query(f"""
WITH e AS ({_EVENTS}), s1 AS (SELECT k, ts, event_id AS e1 FROM e WHERE event_type = 'signup'), s2 AS ({_STEP.format(ids="a.e1", n=2, kind="view", before="s1")}), s3 AS ({_STEP.format(ids="a.e1, a.e2", n=3, kind="signup", before="s2")})
SELECT k, 1 AS step, count(*) AS n FROM s1 GROUP BY k UNION ALL SELECT k, 2, count(*) FROM s2 GROUP BY k UNION ALL SELECT k, 3, count(*) FROM s3 GROUP BY k
""")
def funnel_of_a_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events reach each step where all views and signups have one key."""
    key = F.when(F.col("event_type").isin("view", "signup"), F.lit(0).cast("bigint")).otherwise(F.col("user_id") % 7)
    events = table(spark, sf_dir, "events").select(key.alias("k"), "ts", "event_id", "event_type")
    parts = reached(events, "k", "ts", "event_id", "event_type", ["signup", "view", "signup"], 2 * 3600, 6 * 3600)
    counts = [p.groupBy("k").agg(F.count("*").alias("n")).select("k", F.lit(i).alias("step"), "n") for i, p in enumerate(parts, 1)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


QUERIES, SQL = _queries.queries, _queries.sql
