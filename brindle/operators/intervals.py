"""Overlap joins of two tables of intervals, without a nested loop and without a fixed largest length.

Two closed intervals overlap just when one of them begins inside the other. So a pair is found once, either from a right
row that begins in the left one (later than it), or from a left row that begins in the right one. Both are joins of
points with intervals, and these are equi-joins on the nodes of a tree: the line is cut to cells of `unit`, `FAN` cells
make a cell of the next level, and so on. An interval is the least set of whole cells that covers it, at most
2 * (FAN - 1) a level: an interval of a million units is some thirty rows, not a million. A point is one cell a level, for the levels
up to that of the longest interval. A hot stretch of time is spread over its cells and levels.

Nulls: a null key, begin or end matches nothing, and an interval that ends before it begins is empty. Ties, also of
intervals that are a single point, are pairs. Rows that repeat are pairs each. Empty tables give no rows. Columns that
both tables have, the keys included, would clash in the result and raise an error; rename them before. Own columns begin with `__cell`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from ..sources.tables import table
from .overlaps import overlap_counts
from .registry import Registry
from .temporal import sessionized

#: Cells that make one of the next level.
FAN = 8

_queries = Registry()


def _number(df: DataFrame, name: str) -> Column:
    """A column on one scale: seconds for times (with a fraction) and dates, else the value."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")) / 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(name) * 86400.0
    return F.col(name)


def _cell(df: DataFrame, name: str, unit: float) -> Column:
    return F.floor(_number(df, name) / F.lit(unit)).cast("bigint")


def _parent(at: Column, up: bool = False) -> Column:
    """The cell of the next level, or the first one at or after `at`."""
    return F.floor((at + (FAN - 1 if up else 0)) / F.lit(FAN)).cast("bigint")


def levels(intervals: DataFrame, low: str, high: str, unit: float) -> int:
    """How many levels the longest interval asks for."""
    longest = intervals.agg(F.max(_cell(intervals, high, unit) - _cell(intervals, low, unit))).first()[0]
    n, cells = 1, FAN
    while cells <= (longest or 0):
        n, cells = n + 1, cells * FAN
    return n


def covered(intervals: DataFrame, low: str, high: str, unit: float, n: int) -> DataFrame:
    """A row for each cell of an interval's cover: __cell_level and __cell."""
    rows = intervals.where(F.col(low) <= F.col(high)).withColumns({"__cell_from": _cell(intervals, low, unit), "__cell_to": _cell(intervals, high, unit) + 1})
    begin, end, parts = F.col("__cell_from"), F.col("__cell_to"), []
    for level in range(n):
        # Whole cells of the next level lie in [up * FAN, down * FAN); what is left of them and right of them is of this one.
        up, down = _parent(begin, True), _parent(end)
        last = level == n - 1
        inner_from, inner_to = (end, end) if last else (F.least(up * FAN, end), F.greatest(F.least(up * FAN, end), down * FAN))
        cells = F.concat(_range(begin, inner_from), _range(inner_to, end))
        parts.append(F.transform(cells, _at_level(level)))
        begin, end = (up, F.greatest(up, down))
    return rows.withColumn("__cells", F.explode(F.concat(*parts))).withColumns({"__cell_level": F.col("__cells.level"), "__cell": F.col("__cells.cell")}).drop("__cells", "__cell_from", "__cell_to")


def _at_level(level: int):
    return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))


def _range(begin: Column, end: Column) -> Column:
    return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))


def located(points: DataFrame, at: str, unit: float, n: int) -> DataFrame:
    """A row for each level, with the point's cell there."""
    cell, cells = _cell(points, at, unit), []
    for level in range(n):
        cells.append(F.struct(F.lit(level).alias("level"), cell.alias("cell")))
        cell = _parent(cell)
    rows = points.where(F.col(at).isNotNull()).withColumn("__cells", F.explode(F.array(*cells)))
    return rows.withColumns({"__cell_level": F.col("__cells.level"), "__cell": F.col("__cells.cell")}).drop("__cells")


def point_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, unit: float, on: Sequence[tuple[str, str]] = (), after: bool = False) -> DataFrame:
    """Pairs of a point and an interval that holds it (after: beyond its begin). on: pairs of columns that must be equal."""
    n = levels(intervals, low, high, unit)
    wide, cover = located(points, at, unit, n), covered(intervals, low, high, unit, n)
    for side in ("__cell_level", "__cell"):
        cover = cover.withColumnRenamed(side, f"{side}_of")
    same = (F.col("__cell_level") == F.col("__cell_level_of")) & (F.col("__cell") == F.col("__cell_of"))
    for a, b in on:
        same &= F.col(a) == F.col(b)
    begun = F.col(at) > F.col(low) if after else F.col(at) >= F.col(low)
    found = wide.join(cover, same).where(begun & (F.col(at) <= F.col(high)))
    return found.drop("__cell_level", "__cell", "__cell_level_of", "__cell_of")


def overlap_join(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str], unit: float, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All pairs of rows whose closed intervals overlap, with the columns of both. unit: the width of the smallest cell
    (seconds, for times and dates), best about the length of most intervals; it only decides the cost."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    left, right = left.where(F.col(left_span[0]) <= F.col(left_span[1])), right.where(F.col(right_span[0]) <= F.col(right_span[1]))
    columns = [*left.columns, *right.columns]
    later = point_join(right, right_span[0], left, *left_span, unit, [(b, a) for a, b in on], after=True)
    other = point_join(left, left_span[0], right, *right_span, unit, on)
    return later.select(columns).unionByName(other.select(columns))


def self_overlap_join(df: DataFrame, row: str, span: tuple[str, str], unit: float, on: Sequence[str] = ()) -> DataFrame:
    """All pairs of two rows of a table whose closed intervals overlap, each once: the columns of the one that begins first
    (of equal begins, with the smaller `row`, a unique column), and those of the other with `other_` before their names.

    A row is found by the one that begins first only, so half as many pairs are made as by `overlap_join`."""
    low, high = span
    first = df.where(F.col(low) <= F.col(high))
    other = first.toDF(*(f"other_{c}" for c in df.columns))
    found = point_join(other, f"other_{low}", first, low, high, unit, [(f"other_{c}", c) for c in on])
    later = (F.col(f"other_{low}") > F.col(low)) | (F.col(f"other_{row}") > F.col(row))
    return found.where(later).select(*df.columns, *other.columns)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps of at most two hours, written, as a join reads each side three times."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    numbered = sessionized(events, "user_id", "ts", "event_id", 2 * 3600)
    return written(numbered.groupBy("user_id", "session").agg(F.min("event_id").alias("id"), F.min("ts").alias("low"), F.max("ts").alias("high")))


_SESSIONS = """
WITH n AS (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events
), s AS (
  SELECT min(event_id) AS id, user_id, min(ts) AS low, max(ts) AS high
  FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n) GROUP BY user_id, session
)
"""


@_queries.query(f"""{_SESSIONS}
SELECT a.id, count(*) AS n, CAST(count(DISTINCT b.user_id) AS BIGINT) AS users, max(date_diff('microsecond', greatest(a.low, b.low), least(a.high, b.high))) AS longest
FROM s a JOIN s b ON a.low <= b.high AND b.low <= a.high AND a.user_id <> b.user_id GROUP BY a.id
""")
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session, the sessions of other users that overlap it, and the longest time in common (microseconds)."""
    return session_overlaps(_sessions(spark, sf_dir))


def session_overlaps(sessions: DataFrame) -> DataFrame:
    """id, n, users and longest of written sessions. Their pairs grow with the square of the table, so they are counted without
    making them; only the sessions that share an id, whose users are counted together, are joined with the others."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    timed = written(sessions.where("user_id is not null and low is not null").withColumn("row", F.monotonically_increasing_id()))
    counts = overlap_counts(timed.select("row", F.col("user_id").alias("owner"), micros("low"), micros("high")))
    out = timed.select("row", "id").join(counts, "row").select("id", "n", F.col("owners").alias("users"), "longest")
    shared = written(timed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("shared")))
    if shared.isEmpty():
        return out
    same = F.col("id").eqNullSafe(F.col("shared"))
    return out.join(shared, same, "left_anti").unionByName(_paired(timed.join(shared, same, "left_semi").drop("row"), timed))


def _paired(left: DataFrame, sessions: DataFrame) -> DataFrame:
    right = sessions.select(F.col("user_id").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = overlap_join(left, ("low", "high"), right, ("other_low", "other_high"), 1800).where("user_id <> other")
    common = F.unix_micros(F.least("high", "other_high").cast("timestamp")) - F.unix_micros(F.greatest("low", "other_low").cast("timestamp"))
    return pairs.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("other").alias("users"), F.max(common).alias("longest"))


@_queries.query("""
WITH s AS (
  SELECT l_orderkey AS k, l_suppkey AS supplier, min(l_shipdate) AS low, max(l_shipdate) + INTERVAL 20 DAY AS high FROM lineitem GROUP BY 1, 2
)
SELECT a.supplier, a.k AS first_order, b.k AS second_order FROM s a JOIN s b ON a.supplier = b.supplier AND a.k < b.k AND a.low <= b.high AND b.low <= a.high
""")
def overlapping_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that keep one supplier busy at the same time: overlaps within a key, of spans from a few days to months."""
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey is not null and l_orderkey is not null").groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("supplier"))
    spans = written(lines.agg(F.min("l_shipdate").alias("low"), (F.max("l_shipdate") + F.expr("interval 20 days")).alias("high")))
    pairs = self_overlap_join(spans, "k", ("low", "high"), 10 * 86400, ["supplier"])
    return pairs.select("supplier", F.least("k", "other_k").alias("first_order"), F.greatest("k", "other_k").alias("second_order"))


QUERIES, SQL = _queries.queries, _queries.sql
