"""Recursion: queries that are applied to their own result until nothing new comes.

Spark's `WITH RECURSIVE` suits spines of a few rows a step: it keeps all steps in one plan and has no way to leave out rows
that an earlier step found, so a cycle never ends. `fixpoint` writes each round instead: a round works on the rows that
the one before added, and only keeps what no round had, so cycles end, lineage stays short and a lost executor costs
one round. Rounds are as many as the longest shortest path; small ones are put together, so plans stay small.

Nulls: an edge or seed with a null end is left out. Repeated edges and seeds, and edges from a node to itself, change nothing.
Without seeds there are no rows; without edges, only the seeds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from ..sources.tables import register, table
from .registry import Registry

#: Rounds that stand in tables of their own before they are put together.
APART = 6

_queries = Registry()


def _all(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], most: int | None = None, depth: str = "depth") -> DataFrame:
    """start, and what `step` makes of the newest rows, round by round, until no row has new keys or `most` rounds are done.

    Only columns of start are kept, and `depth`: the round, from 0, in which a row's keys were found first. Of rows of one
    round with the same keys one stays, so columns beside the keys should depend on them."""
    columns, seen = start.columns, []
    newest = written(start.dropDuplicates(list(keys)).withColumn(depth, F.lit(0)))
    seen.append(newest)
    n = 0
    while (most is None or n < most) and not newest.isEmpty():
        n += 1
        known = _all([t.select(*keys) for t in seen])
        found = step(newest.select(*columns)).select(*columns).dropDuplicates(list(keys))
        newest = written(found.join(known, list(keys), "left_anti").select(*columns).withColumn(depth, F.lit(n)))
        seen.append(newest)
        if len(seen) > APART:
            one = written(_all(seen[:-1]))
            discard(*seen[:-1])
            seen = [one, newest]
    return _all(seen)


def reachable(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """edges (a, b), seeds (source, node) -> source, node, depth: every node that can be reached from a source's seeds, with
    the fewest edges to it."""
    ways = written(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    begin = seeds.select("source", "node").where("source is not null and node is not null")
    step = lambda newest: newest.join(ways, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"))
    return fixpoint(begin, step, ["source", "node"], most)


@_queries.query("""
WITH RECURSIVE e AS (
  SELECT DISTINCT l_suppkey AS s, -o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50 AND l_discount >= 0.06
), ways AS (
  SELECT s AS a, c AS b FROM e UNION SELECT c, s FROM e
), r AS (
  SELECT s_suppkey AS source, s_suppkey AS node, 0 AS depth FROM supplier WHERE s_nationkey = 3
  UNION
  SELECT source, b, depth + 1 FROM r JOIN ways ON node = a WHERE depth < 6
)
SELECT source, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY source, node
""")
def supplier_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppliers of a nation reach in up to six steps between suppliers and customers (negative) who share a
    large, discounted line: a graph with cycles."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount >= 0.06").select("l_orderkey", F.col("l_suppkey").alias("s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_custkey")).alias("c"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("s").alias("a"), F.col("c").alias("b"))
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("source"), F.col("s_suppkey").alias("node"))
    return reachable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), seeds, 6)


_QUARTERS = """
WITH RECURSIVE quarters(quarter) AS (
  SELECT {first} FROM orders UNION ALL SELECT {next} FROM quarters WHERE quarter < (SELECT {of} FROM (SELECT max(o_orderdate) AS o_orderdate FROM orders))
)
SELECT quarter, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending FROM quarters LEFT JOIN orders ON {of} = quarter GROUP BY quarter
"""


@_queries.query(_QUARTERS.format(first="CAST(date_trunc('quarter', min(o_orderdate)) AS DATE)", next="CAST(quarter + INTERVAL 3 MONTH AS DATE)", of="CAST(date_trunc('quarter', o_orderdate) AS DATE)"))
def orders_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive query in SQL: every quarter from the first order to the last, also one without orders."""
    register(spark, sf_dir, "orders")
    return spark.sql(_QUARTERS.format(first="to_date(date_trunc('quarter', min(o_orderdate)))", next="add_months(quarter, 3)", of="to_date(date_trunc('quarter', o_orderdate))"))


QUERIES, SQL = _queries.queries, _queries.sql
