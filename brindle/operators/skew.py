"""Equi-joins where a few keys hold a large part of the rows.

A count-min sketch of each side's keys (three rows of counts of hashes, summed over the tasks) bounds how often a key
occurs; the few keys whose bound is above a share of all rows are then counted, which gives the hot ones, at most 1 / share a
side. Rows of other keys are joined plainly. Rows of hot keys are joined on a grid: a key's left rows are dealt to so many
columns and its right rows to so many rows, by its counts on both sides, and each is copied along the other direction.
A cell holds about `cell` rows of a side, so no task gets a whole hot key of either side. A key has at most about `CELLS` cells:
beyond that they grow with the key, so copies grow with the rows and not with the pairs. The copies are merge-joined,
never broadcast: Spark sees the size of the written rows, not that of their copies.

Where hot keys have many pairs for each row, what is copied and joined are packs of `PACK` rows, and the pairs of two packs
follow each other. Files of the result then repeat the same few values in turn, which their encodings need to stay small: row by
row against whole cells, each page of a file holds long stretches without a repeat. Tasks are counted by pairs there, as Spark
would count them by the bytes of the packs. A task holds the pairs of two packs at once, so rows with columns without a fixed
width (strings, arrays) are not packed.

Outer joins: a row of a hot key finds a partner just when the other side has that key, which is settled on the few hot
keys; rows without one are added with nulls. Rows with a null key match nothing and are not shuffled.

The deal of hot rows is a column of a written table, so a lost executor can't change it. Rows that repeat are pairs each;
tables may be empty. Keys of unlike types, and columns that both sides have, raise an error. Own columns begin with
`__skew`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from ..sources.tables import table
from .registry import Registry

#: A key with more than this part of a side's rows is hot.
SHARE = 0.01

#: Rows of one side in a cell of the grid.
CELL = 1_000_000

#: Cells of a key's grid.
CELLS = 256

#: Rows of a pack, and the pairs for each row from which rows are packed; a multiple of 8, as files pack indices by eights.
PACK = 64

#: Types whose values have a bounded width.
FIXED = (T.NumericType, T.BooleanType, T.DatetimeType, T.AnsiIntervalType)

#: Pairs for each task, where rows are packed, and the most tasks.
PAIRS, TASKS = 16_000_000, 8192

#: Rows of the sketch; each has 4 / share counts.
DEPTH = 3

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")

_queries = Registry()


def _known(keys: Sequence[str]) -> Column:
    """All keys are given, so equality can hold."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).isNotNull()
    return out


def sketch(hashes: DataFrame, width: int) -> list[list[int]]:
    """DEPTH rows of `width` counts of a column h of hashes."""
    out = [[0] * width for _ in range(DEPTH)]
    seats = F.array(*(F.struct(F.lit(d).alias("d"), _seat(d, width).alias("b")) for d in range(DEPTH)))
    for r in hashes.select(F.explode(seats).alias("s")).groupBy("s.d", "s.b").agg(F.count("*").alias("n")).collect():
        out[r["d"]][r["b"]] = r["n"]
    return out


def _seat(row: int, width: int) -> Column:
    return F.pmod(F.xxhash64("h", F.lit(row)), F.lit(width))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE) -> dict[int, int]:
    """Hash -> rows, for the keys with more than `share` of the rows whose keys are known. All keys that the sketch
    can't rule out are counted exactly."""
    hashes, width = df.where(_known(keys)).select(F.xxhash64(*keys).alias("h")), 4 * math.ceil(1 / share)
    counts = sketch(hashes, width)
    least, likely = share * sum(counts[0]), F.lit(True)
    for d, row in enumerate(counts):
        full = [b for b, n in enumerate(row) if n > least]
        if not full:
            return {}
        likely &= _seat(d, width).isin(full)
    found = hashes.where(likely).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return {r["h"]: r["n"] for r in found.collect()}


def grid(n_left: int, n_right: int, cell: int) -> tuple[int, int]:
    """Columns and rows of a hot key's grid."""
    columns, rows = max(1, math.ceil(n_left / cell)), max(1, math.ceil(n_right / cell))
    if min(columns, rows) > 1 and columns * rows > CELLS:
        less = math.sqrt(columns * rows / CELLS)
        columns, rows = math.ceil(columns / less), math.ceil(rows / less)
    return columns, rows


def _parts(parts: dict[int, int]) -> Column:
    """How many parts a hot key's rows are dealt to, by its hash."""
    entries = [F.lit(x) for entry in parts.items() for x in entry]
    return F.element_at(F.create_map(*entries), F.col("__skew_hash"))


def _absent(df: DataFrame, like: DataFrame, first: bool) -> DataFrame:
    """df with the columns of `like` as nulls, before or behind its own."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    return df.select(*none, *df.columns) if first else df.select(*df.columns, *none)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", share: float = SHARE, cell: int = CELL) -> DataFrame:
    """left joined with right where the pairs of columns in `on` are equal; how: one of KINDS."""
    lk, rk = [a for a, _ in on], [b for _, b in on]
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    if unlike := [(a, b) for a, b in on if left.schema[a].dataType != right.schema[b].dataType]:
        raise ValueError(f"keys of unlike types: {unlike}")
    same = [F.col(a) == F.col(b) for a, b in on]
    hot = sorted({*heavy_keys(left, lk, share), *heavy_keys(right, rk, share)})
    parts = []
    if how in ("left", "full"):
        parts.append(_absent(left.where(~_known(lk)), right, False))
    if how in ("right", "full"):
        parts.append(_absent(right.where(~_known(rk)), left, True))
    if how == "left_anti":
        parts.append(left.where(~_known(lk)))
    known_left, known_right = left.where(_known(lk)), right.where(_known(rk))
    is_hot = lambda keys: F.xxhash64(*keys).isin(hot)
    if hot:
        parts.append(known_left.where(~is_hot(lk)).join(known_right.where(~is_hot(rk)), same, how))
        parts += _hot_parts(known_left.where(is_hot(lk)), known_right.where(is_hot(rk)), lk, rk, how, cell)
    else:
        parts.append(known_left.join(known_right, same, how))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _packs(drawn: DataFrame, columns: list[str], keys: list[str], own: str, rows: str) -> DataFrame:
    """Arrays `rows` of up to PACK rows of one key and place, numbered by a written column, so a lost executor can't change them.
    All but a place's last one are full."""
    order = Window.partitionBy("__skew_hash", *keys, own).orderBy("__skew_n")
    numbered = drawn.withColumn("__skew_pack", F.floor((F.row_number().over(order) - 1) / PACK))
    packed = numbered.groupBy("__skew_hash", *keys, own, "__skew_pack").agg(F.collect_list(F.struct(*columns)).alias(rows))
    return packed.drop("__skew_pack")


def _hot_parts(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str], how: str, cell: int) -> list[DataFrame]:
    """The parts of the result that rows of hot keys give. There are few hot keys, so tables of keys are broadcast."""
    same = [F.col(a) == F.col(b) for a, b in zip(lk, rk)]
    left_keys, right_keys = left.select(*lk).distinct(), right.select(*rk).distinct()
    if how in ("left_semi", "left_anti"):
        return [left.join(F.broadcast(right_keys), same, how)]
    count = lambda df, keys: {r["h"]: r["n"] for r in df.select(F.xxhash64(*keys).alias("h")).groupBy("h").agg(F.count("*").alias("n")).collect()}
    n_left, n_right = count(left, lk), count(right, rk)
    both = {h for h in n_left if h in n_right}
    out = []
    if both:
        grids = {h: grid(n_left[h], n_right[h], cell) for h in sorted(both)}
        of_left, of_right = _parts({h: g[0] for h, g in grids.items()}), _parts({h: g[1] for h, g in grids.items()})
        pairs = sum(n_left[h] * n_right[h] for h in both)
        narrow = all(isinstance(f.dataType, FIXED) for f in [*left.schema, *right.schema])
        pack = narrow and pairs > PACK * sum(n_left[h] + n_right[h] for h in both)
        tasks = min(TASKS, math.ceil(pairs / PAIRS)) if pack else 0

        def dealt(df: DataFrame, keys: list[str], own: str, deal: Column, other: str, copies: Column, rows: str) -> DataFrame:
            """df, or packs of it, with a drawn place in its own direction, and a copy for each place in the other."""
            hashed = df.withColumn("__skew_hash", F.xxhash64(*keys)).where(F.col("__skew_hash").isin(sorted(both)))
            drawn = hashed.withColumn(own, F.floor(F.rand(7) * deal).cast("int"))
            if pack:
                placed = _packs(written(drawn.withColumn("__skew_n", F.monotonically_increasing_id())), df.columns, keys, own, rows)
            else:
                placed = written(drawn)
            copied = placed.withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1))).drop("__skew_hash")
            few = tasks <= df.sparkSession.sparkContext.defaultParallelism
            return copied if few else copied.repartition(tasks, *keys, *sorted((own, other)))

        a = dealt(left, lk, "__skew_i", of_left, "__skew_j", of_right, "__skew_a")
        b = dealt(right, rk, "__skew_j2", of_right, "__skew_i2", of_left, "__skew_b")
        place = [F.col("__skew_i") == F.col("__skew_i2"), F.col("__skew_j") == F.col("__skew_j2")]
        met = a.join(b.hint("merge"), [*same, *place])
        if pack:
            met = met.select(F.explode("__skew_a").alias("__skew_a"), "__skew_b").select("__skew_a", F.explode("__skew_b").alias("__skew_b"))
            out.append(met.select("__skew_a.*", "__skew_b.*"))
        else:
            out.append(met.select(*left.columns, *right.columns))
    if how in ("left", "full"):
        out.append(_absent(left.join(F.broadcast(right_keys), same, "left_anti"), right, False))
    if how in ("right", "full"):
        out.append(_absent(right.join(F.broadcast(left_keys), same, "left_anti"), left, True))
    return out


@_queries.query("""
SELECT event_id, account, c_mktsegment FROM (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'error' THEN NULL ELSE user_id END AS account FROM events)
LEFT JOIN customer ON c_custkey = account
""")
def accounts_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their customer, where all views and clicks are of one customer and errors of none."""
    kind = F.col("event_type")
    account = F.when(kind.isin("view", "click"), F.lit(1).cast("bigint")).when(kind != "error", F.col("user_id"))
    events = table(spark, sf_dir, "events").select("event_id", account.alias("account"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return skew_join(events, customers, [("account", "c_custkey")], "left", cell=10_000).drop("c_custkey")


@_queries.query("""
SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 3) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey <> 4) ON c_nationkey = s_nationkey
""")
def neighbours_in_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of one nation: every key is hot on both sides, and two are on one side only."""
    customers = table(spark, sf_dir, "customer").where("c_nationkey <> 3").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey <> 4").select("s_suppkey", "s_nationkey")
    return skew_join(customers, suppliers, [("c_nationkey", "s_nationkey")], "full", cell=200).select("c_custkey", "s_suppkey")


QUERIES, SQL = _queries.queries, _queries.sql
