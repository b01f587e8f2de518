"""What each of many intervals has in common with all others, without making the pairs: how many overlap it, of how many
owners, and the longest common part. Rows: `row` (a unique number), `owner`, `low` and `high` (whole numbers, low <= high,
no nulls). Intervals of one owner don't touch each other, so an interval has partners of other owners only.

All begins and ends are put in one order (`ordered.placed`): by value, begins first, longer intervals first. Running
counts and extremes in that order, forwards and backwards, with a small row for each range carried over, give the rest:

- partners: begins up to the own end, less ends before the own begin, less one;
- longest common part: with an interval that comes before in the order, with the one of largest end; with one that ends
  after, with the one of least begin; with one inside, only if no other interval holds that one too, as else the
  common part with that other is as long. So each interval is given to its holder, if it has just one;
- owners: partners, less the gaps between two intervals of one owner that lie inside the own one.

The gaps inside are counted by the ranges of their two ends: those that begin and end in ranges strictly between
from a table of counts by pairs of ranges; the others within the range of the begin or of the end, each by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordered import _SHIFT, PLACE, RANGE, _of_range, placed

_START = Window.unboundedPreceding


def _top(a: tuple, b: tuple) -> tuple:
    """The largest (end, row) and the second largest end of both."""
    found = sorted([x for x in (a[0], (a[1], -1), b[0], (b[1], -1)) if x and x[0] is not None], key=lambda x: (-x[0], -x[1]))
    return (found[0] if found else None), (found[1][0] if len(found) > 1 else None)


def _with_edges(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with lows and highs (begins and ends before), top, top_row and second (the largest end of the intervals that
    began before, whose it is, and the next) and least (the least begin of those that end after); the number of ranges."""
    low = F.col("side") == 0
    before, after = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(_START, -1), Window.partitionBy(RANGE).orderBy(F.desc(PLACE)).rowsBetween(_START, -1)
    own = rows.withColumns({
        "lows": F.coalesce(F.sum(F.when(low, 1).otherwise(0)).over(before), F.lit(0)).cast("bigint"),
        "top": F.max(F.when(low, F.struct("other", "row"))).over(before),
        "least": F.min(F.when(~low, F.col("other"))).over(after),
    })
    lesser = F.when(low & F.col("top").isNotNull(), F.least("other", "top.other"))  # the largest of these is the second largest end
    own = own.withColumn("second", F.max(lesser).over(before))
    edges = own.groupBy(RANGE).agg(F.count_if(low).alias("lows"), F.count_if(~low).alias("highs"), F.max(F.when(low, F.struct("other", "row"))).alias("top"), F.max(lesser).alias("second"), F.min(F.when(~low, F.col("other"))).alias("least"))
    found = {e[RANGE]: e for e in edges.collect()}
    listed = [found.get(i) for i in range(max(found, default=0) + 1)]
    lows, highs, tops, leasts = [0], [0], [(None, None)], [None]
    for e in listed:
        lows.append(lows[-1] + (e["lows"] if e else 0))
        highs.append(highs[-1] + (e["highs"] if e else 0))
        tops.append(_top(tops[-1], (tuple(e["top"]) if e["top"] else None, e["second"])) if e else tops[-1])
    for e in reversed(listed):
        leasts.append(min((x for x in (leasts[-1], e and e["least"]) if x is not None), default=None))
    n = len(listed)
    ends, whose = [t[0][0] if t[0] else None for t in tops[:n]], [t[0][1] if t[0] else None for t in tops[:n]]
    of = lambda values: _of_range(values, "bigint")
    here, carried = F.col("top.other"), of(ends)
    both = F.when(here.isNotNull() & carried.isNotNull(), F.least(here, carried))
    return own.withColumns({
        "lows": of(lows[:n]) + F.col("lows"), "highs": of(highs[:n]) + F.col(PLACE) - F.col("lows"),
        "top": F.greatest(here, carried), "top_row": F.when(carried.isNull() | (here >= carried), F.col("top.row")).otherwise(of(whose)),
        "second": F.greatest("second", of([t[1] for t in tops[:n]]), both), "least": F.least("least", of(leasts[:n][::-1])),
    }), n


def _struct(row: Column, n: Column, longest: Column, begin: Column, end: Column, at_begin: Column, at_end: Column, owner: Column) -> Column:
    named = {"row": row, "n": n, "longest": longest, "low": begin, "high": end, "at_low": at_begin, "at_high": at_end, "owner": owner}
    return F.struct(*(c.alias(k) for k, c in named.items()))


def _partners(spans: DataFrame) -> tuple[DataFrame, int]:
    """row, owner, low, high, at_low and at_high (places of begin and end), n and longest; the number of ranges."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("at"), F.col("high").alias("other")), F.struct(F.lit(1).alias("side"), F.col("high").alias("at"), F.col("low").alias("other")))
    rows, ranges = _with_edges(placed(spans.select("row", "owner", F.explode(both).alias("e")).select("row", "owner", "e.*"), ["at", "side", "-other", "row"]))
    low, at, other, none = F.col("side") == 0, F.col("at"), F.col("other"), F.lit(None).cast("bigint")
    place = F.shiftleft(F.col(RANGE), _SHIFT) + F.col(PLACE)
    longest = F.when(low & (F.col("top") >= at), F.least("top", "other") - at).when(~low & (F.col("least") <= at), at - F.greatest("least", "other"))
    own = _struct(F.col("row"), F.when(low, -F.col("highs")).otherwise(F.col("lows") - 1), longest, F.when(low, at), F.when(~low, at), F.when(low, place), F.when(~low, place), F.col("owner"))
    holder = F.when(low & (F.col("top") >= other) & (F.col("second").isNull() | (F.col("second") < other)), F.col("top_row"))
    owner = dict(spans.dtypes)["owner"]
    inside = _struct(holder, F.lit(0).cast("bigint"), other - at, none, none, none, none, F.lit(None).cast(owner))
    parts = rows.select(F.explode(F.array(own, inside)).alias("p")).select("p.*").where("row is not null")
    return parts.groupBy("row").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("longest", "low", "high", "at_low", "at_high", "owner"))), ranges


def dominated(x: np.ndarray, y: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query, how many points have x >= least and y <= most: by y, a prefix of the points, which is a block of
    2^k points for each bit of its length; each block is sorted by x."""
    by, n = np.argsort(y, kind="stable"), len(x)
    ranks = np.sort(x)
    rank, asked, upto = np.searchsorted(ranks, x[by]), np.searchsorted(ranks, least), np.searchsorted(y[by], most, "right")
    out = np.zeros(len(least), np.int64)
    for k in range(n.bit_length()):
        has = (upto >> k) & 1 == 1
        if has.any():
            keys, block = np.sort((np.arange(n) >> k) * (n + 1) + rank), (upto[has] >> k) - 1
            out[has] += ((block + 1) << k) - np.searchsorted(keys, block * (n + 1) + asked[has])
    return out


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    asks = rows["row"].to_numpy() >= 0
    points, queries = rows[~asks], rows[asks]
    n = dominated(*(d[c].to_numpy() for d in (points, queries) for c in ("x", "y")))
    return pd.DataFrame({"row": queries["row"].to_numpy(), "inside": n})


def _gaps_inside(whole: DataFrame, ranges: int) -> DataFrame | None:
    """row and inside: how many gaps between neighbours of one owner lie in the row's interval; None if none can."""
    spark = whole.sparkSession
    following = Window.partitionBy("owner").orderBy("at_low")
    gaps = whole.select(F.col("at_high").alias("x"), F.lead("at_low").over(following).alias("y"), (F.lead("low").over(following) - F.col("high")).alias("size")).where("y is not null")
    longest, least = whole.agg(F.max(F.col("high") - F.col("low"))).first()[0], gaps.agg(F.min("size")).first()[0]
    if least is None or longest < least:
        return None
    slab = lambda c: F.shiftright(c, _SHIFT)
    points = gaps.where(F.col("size") <= longest).withColumns({"p": slab("x"), "q": slab("y"), "row": F.lit(-1).cast("bigint")})
    asks = whole.where(F.col("high") - F.col("low") >= least).select("row", F.col("at_low").alias("x"), F.col("at_high").alias("y"), slab("at_low").alias("p"), slab("at_high").alias("q"))
    rows = [d.select(F.lit(kind).alias("kind"), F.col(at).alias("slab"), x.alias("x"), "y", "row") for d, more in ((points, 0), (asks, 1)) for kind, at, x in ((0, "p", F.col("x")), (1, "q", F.col("p") + more))]
    edge = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).groupBy("kind", "slab").applyInPandas(_count, "row long, inside long")
    # Of all pairs of ranges, the gaps that begin after p and end before q.
    pairs = spark.range(ranges * ranges).select(F.floor(F.col("id") / ranges).alias("p"), F.col("id").alias("q") % ranges)
    pairs = pairs.toDF("p", "q").join(points.groupBy("p", "q").agg(F.count("*").alias("n")), ["p", "q"], "left")
    pairs = pairs.withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("p").orderBy("q").rowsBetween(_START, -1)))
    pairs = pairs.withColumn("inside", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("p")).rowsBetween(_START, -1)))
    between = asks.join(pairs.where("inside > 0").select("p", "q", "inside"), ["p", "q"]).select("row", "inside")
    return edge.union(between).groupBy("row").agg(F.sum("inside").alias("inside"))


def overlap_counts(spans: DataFrame) -> DataFrame:
    """row, n (intervals that overlap it), owners (of how many owners) and longest (common part), for the rows with n > 0."""
    found, ranges = _partners(spans)
    whole = written(found)
    inside = _gaps_inside(whole, ranges)
    out = whole.where("n > 0")
    if inside is None:
        return out.select("row", "n", F.col("n").alias("owners"), "longest")
    return out.join(inside, "row", "left").select("row", "n", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("owners"), "longest")
