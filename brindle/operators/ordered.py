"""Row numbers, ranks and running totals over all rows or over keys of any size.

A window without a partition brings all rows to one task, and a window over a hot key brings that key's rows there. Here
the rows are cut to ranges of the order itself (`repartitionByRange`), sorted within each and written with their place:
number of the range and row in it. What lies before a range then comes from one small row for each range, so no task
holds more than a range, whatever the keys.

Order columns are names, descending with a leading "-". Nulls come first, descending ones last, as in Spark. Rows that
tie in all order columns are numbered in some order, fixed once they are written; give further columns to settle it.
An empty table gives no rows. Columns of the input must not begin with `__place`.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.tables import table
from .registry import Registry

PLACE, RANGE = "__place", "__place_range"
_SHIFT = 33  # of monotonically_increasing_id: the range's number stands above, the row in it below
_queries = Registry()


def _order(names: Sequence[str]) -> list[Column]:
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def _plain(names: Sequence[str]) -> list[str]:
    return [n.removeprefix("-") for n in names]


def placed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df in the order of names, written, with its range and its row in the range (from 0)."""
    by = _order(names)
    out = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PLACE, F.monotonically_increasing_id()))
    return out.withColumn(RANGE, F.shiftright(PLACE, _SHIFT)).withColumn(PLACE, F.col(PLACE).bitwiseAND(F.lit((1 << _SHIFT) - 1)))


def _of_range(values: Sequence, kind: str) -> Column:
    """values[range] as a literal: one value for each range, so its size is the number of ranges."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col(RANGE).cast("int") + 1)


def _sizes(rows: DataFrame) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy(RANGE).agg(F.count("*")).collect()}
    return [found.get(i, 0) for i in range(max(found, default=0) + 1)]


def _numbered(rows: DataFrame, sizes: Sequence[int], name: str) -> DataFrame:
    before = [0, *itertools.accumulate(sizes)][:-1]
    return rows.withColumn(name, _of_range(before, "bigint") + F.col(PLACE) + 1)


def numbered(df: DataFrame, names: Sequence[str], name: str = "row_number") -> DataFrame:
    """df with each row's number, from 1, in the order of names."""
    rows = placed(df, names)
    return _numbered(rows, _sizes(rows), name).drop(PLACE, RANGE)


def ranked(df: DataFrame, names: Sequence[str], unique: Sequence[str] = (), tiles: int = 100) -> DataFrame:
    """df with row_number, rank, dense_rank, percent_rank and ntile (of `tiles`) over all rows in the order of names.

    unique: columns that settle ties for row_number and ntile; they also let a value that many rows share be cut to
    several ranges. Rank and dense rank are numbers of groups of equal values, joined back; a hot value is a skewed
    join that adaptive execution can split."""
    rows = placed(df, [*names, *unique])
    sizes = _sizes(rows)
    n = sum(sizes)
    own = written(_numbered(rows, sizes, "row_number").drop(PLACE, RANGE))
    keys = _plain(names)
    groups = own.groupBy(*keys).agg(F.min("row_number").alias("rank"))
    groups = numbered(groups, ["rank"], "dense_rank").select(*(F.col(k).alias(f"__place_{k}") for k in keys), "rank", "dense_rank")
    same = [own[k].eqNullSafe(groups[f"__place_{k}"]) for k in keys]
    out = own.join(groups, same).drop(*(f"__place_{k}" for k in keys))
    wide, more = divmod(n, tiles)  # the first `more` tiles have one row more
    number = F.col("row_number")
    far = F.floor((number - more * (wide + 1) - 1) / max(wide, 1)) + more + 1
    tile = F.when(number <= more * (wide + 1), F.floor((number - 1) / (wide + 1)) + 1).otherwise(far)
    return out.withColumn("percent_rank", (F.col("rank") - 1) / F.lit(float(max(n - 1, 1)))).withColumn("ntile", tile.cast("int"))


def _carried(edges: Sequence[Row | None], sums: Sequence[str]) -> list[dict]:
    """What each range takes over: for its first key, the sums of that key's rows in the ranges before."""
    out, key, none = [], None, dict.fromkeys(sums)
    so_far = none
    for e in edges:
        first, last = (e["first"], e["last"]) if e else (None, None)
        before = so_far if e and key == first["key"] else none
        out.append(before)
        if e:  # a range without rows changes nothing
            begun = before if first["key"] == last["key"] else none
            key = last["key"]
            so_far = {s: last[s] if begun[s] is None else begun[s] if last[s] is None else begun[s] + last[s] for s in sums}
    return out


def cumulated(df: DataFrame, names: Sequence[str], values: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """df with running sums in the order of names: values maps a new column to the column that it sums, from the first
    row of its key (`by`, or all rows) up to its own. Nulls add nothing; before the first value a sum is null.

    Ranges are cut by (by, names), so a hot key is cut to several. Only the first key of a range can have rows before
    it, and takes their sums over. Sums are exact for integers and decimals; of doubles the order of additions differs."""
    rows = placed(df, [*by, *names])
    sums = [f"__place_s{i}" for i in range(len(values))]
    key = F.struct(*by) if by else F.struct(F.lit(0))
    parts = rows.groupBy(RANGE, *by).agg(*(F.sum(c).alias(s) for s, c in zip(sums, values.values())), F.count("*").alias("__place_n"), F.min(PLACE).alias(PLACE))
    whole = F.struct(key.alias("key"), F.col("__place_n").alias("n"), *sums)
    edges = {r[RANGE]: r for r in parts.groupBy(RANGE).agg(F.min_by(whole, PLACE).alias("first"), F.max_by(whole, PLACE).alias("last")).collect()}
    listed = [edges.get(i) for i in range(max(edges, default=0) + 1)]
    carried, kinds = _carried(listed, sums), dict(parts.dtypes)
    in_first = F.col(PLACE) < _of_range([e["first"]["n"] if e else 0 for e in listed], "bigint")
    within = Window.partitionBy(RANGE, *by).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    added = {}
    for s, (v, c) in zip(sums, values.items()):
        own, before = F.sum(c).over(within), F.when(in_first, _of_range([x[s] for x in carried], kinds[s]))
        added[v] = F.coalesce(own + before, own, before)
    return rows.withColumns(added).drop(PLACE, RANGE)


@_queries.query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER w AS BIGINT) AS n,
  CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) OVER w AS BIGINT) AS revenue
FROM lineitem
WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue so far (in ten-thousandths) and the number of each line, over all lines in order of shipping."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("bigint")
    lines = table(spark, sf_dir, "lineitem").select(*order, cents.alias("cents"), F.lit(1).cast("bigint").alias("one"))
    return cumulated(lines, order, {"n": "one", "revenue": "cents"}).select("l_orderkey", "l_linenumber", "l_partkey", "n", "revenue")


@_queries.query("""
SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS row_number, CAST(rank() OVER v AS BIGINT) AS rank, CAST(dense_rank() OVER v AS BIGINT) AS dense_rank,
  round(percent_rank() OVER v, 8) AS percent_rank, CAST(ntile(100) OVER w AS INTEGER) AS ntile
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS price FROM orders)
WINDOW w AS (ORDER BY price DESC, o_orderkey), v AS (ORDER BY price DESC)
""")
def global_order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all orders by their price in thousands, with many ties."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("price"))
    out = ranked(orders, ["-price"], ["o_orderkey"])
    return out.select("o_orderkey", "row_number", "rank", "dense_rank", F.round("percent_rank", 8).alias("percent_rank"), "ntile")


@_queries.query("""
SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total
FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE user_id END AS account FROM events)
WINDOW w AS (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by account, where views and clicks share one account, so a large part of the rows has one key."""
    account = F.when(F.col("event_type").isin("view", "click"), 0).otherwise(F.col("user_id"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", account.alias("account"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.lit(1).cast("bigint").alias("one"))
    return cumulated(events, ["ts", "event_id"], {"n": "one", "total": "cents"}, by=["account"]).select("event_id", "n", "total")


QUERIES, SQL = _queries.queries, _queries.sql
