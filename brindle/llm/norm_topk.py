"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets. For a query q and a bucket whose
longest vector has length l, a vector can only reach the query's k-th best score
t if its cosine to q is at least t / (|q| l): the local threshold. Above 1 the
bucket is skipped; a high threshold prunes by coordinates (a vector of cosine c
to q has every unit coordinate inside an interval around c * q_f); a low one
prunes by length only. What is left is verified with exact integer products.

Queries and vectors meet in a grid: query blocks x vector shards, with bounded
cells. Each query first gets a lower bound of its k-th best score from SEEDS of
the longest vectors (a bounded broadcast), so every cell prunes at once. Shards
are cut by length: a query is not sent to shards whose longest vector cannot reach
its bound, and a shard only to blocks with a query that is sent to it. Inside a
cell, lengths are cut again to buckets.

Defined cases: vectors null, empty, or with null or non-finite components take
no part, nor do rows with null id; vectors of other dimensions than the query's
are no candidates; of rows that repeat a query id the smallest vector is the
query, and rows with the query's id are never its candidates; rows that repeat
are candidates each; ties go to the smaller id; scores outside the range of a
long are held at its ends. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

TOP = 5
#: The longest vectors, sent to all executors to seed the thresholds.
SEEDS = 1024
#: Rows of a grid cell's sides at most (in the mean).
CELL_QUERIES, CELL_VECTORS = 2048, 8192
#: Groups of lengths that shards are cut by, and pairs of a query block and a group up to which they are sent to all.
GROUPS, PAIRS_MOST = 64, 1 << 18
#: Rows of a bucket at least, and the ratio of lengths at which a bucket ends.
BUCKET_ROWS, BUCKET_RATIO = 512, 0.9
#: From this local threshold on, coordinates prune; this many of the query's largest are looked at.
COORD_FROM, FOCUS = 0.8, 6
LONG = np.iinfo(np.int64)
OUT = "query_id long, vec_id long, score long"


def quantized(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components floor(256 x) as doubles, of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    # A double holds floor(256 x) also where a long would overflow.
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: _floor(c.cast("double") * 256.0)).alias("v"))


def _floor(c: Column) -> Column:
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def _matrices(batch: pa.Table | pa.RecordBatch, *more: str) -> dict[int, list[np.ndarray]]:
    """By dimension: ids, vectors, and further columns."""
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    others = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if not isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c).to_numpy()) for c in more]
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[int(d)] = [flat[starts[at][:, None] + np.arange(d)], *(o[at] for o in others)]
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q and v, as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(whole, LONG.min, LONG.max).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.score = k, np.full((n, k), LONG.min, np.int64)
        self.id, self.has = np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.floor = floor.astype(np.float64)  # no lower score can be among the k best

    def bound(self) -> np.ndarray:
        full = self.has.all(axis=1)
        return np.maximum(self.floor, np.where(full, self.score[:, -1].astype(np.float64), -np.inf))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """score[i, j] of query rows[i] and ids[j], where fit[i, j]."""
        s = np.concatenate([self.score[rows], score], axis=1)
        h = np.concatenate([self.has[rows], fit], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        if s.shape[1] > 4 * self.k:  # first the columns that can count at all
            rank = np.where(h, s, LONG.min)
            cut = np.partition(rank, -self.k, axis=1)[:, -self.k]
            wide = int(((rank >= cut[:, None]) & h).sum(axis=1).max(initial=0))
            pick = np.argsort(~((rank >= cut[:, None]) & h), axis=1, kind="stable")[:, : max(wide, self.k)]
            s, h, i = (np.take_along_axis(x, pick, axis=1) for x in (s, h, i))
        order = np.lexsort((i, _down(s), ~h), axis=1)[:, : self.k]
        self.score[rows], self.id[rows], self.has[rows] = (np.take_along_axis(x, order, axis=1) for x in (s, i, h))


def _down(s: np.ndarray) -> np.ndarray:
    return ~s  # order-reversing without overflow


def search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int = TOP) -> Best:
    """The k best of v for each row of q, among scores that reach floor."""
    best = Best(len(q), k, floor)
    length = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((v_ids, -length))
    v, v_ids, length = v[order], v_ids[order], length[order]
    q_length = np.sqrt((q * q).sum(axis=1))
    low, n = 0, len(v)
    while low < n:
        high = min(n, low + BUCKET_ROWS)
        while high < n and high < low + 4 * BUCKET_ROWS and length[high] >= BUCKET_RATIO * length[low]:
            high = min(n, high + BUCKET_ROWS)
        reach = q_length * length[low] * (1 + 1e-9) + 1e-6
        bound = best.bound()
        live = np.flatnonzero(reach >= bound)  # local threshold at most 1
        if not len(live):
            if not (bound < 0).any():
                break  # shorter vectors reach no less-than-seen positive bound either
            low = high
            continue
        local = np.where(reach[live] > 0, bound[live] / np.maximum(reach[live], 1e-300), -1.0)
        sharp = live[local >= COORD_FROM]
        dull = live[local < COORD_FROM]
        if len(dull):
            # Length pruning: the prefix of the bucket that the least demanding query still needs.
            need = bound[dull] / np.maximum(q_length[dull] * (1 + 1e-9), 1e-300)
            stop = high if (bound[dull] <= 0).any() else low + int(np.searchsorted(-length[low:high], -need.min() + 1e-6, "right"))
            if stop > low:
                for at in range(0, len(dull), 256):
                    rows = dull[at : at + 256]
                    s = products(q[rows], v[low:stop])
                    best.add(rows, s, v_ids[low:stop], (v_ids[low:stop] != q_ids[rows][:, None]) & (s >= bound[rows][:, None]))
        if len(sharp):
            part = v[low:high]
            unit = part / np.maximum(length[low:high], 1e-300)[:, None]
            by = np.argsort(unit, axis=0)
            sorted_unit = np.take_along_axis(unit, by, axis=0)
            for r in sharp:
                t = min(1.0, bound[r] / reach[r])
                qu = q[r] / max(q_length[r], 1e-300)
                focus = np.argsort(-np.abs(qu), kind="stable")[:FOCUS]
                half = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - qu[focus] ** 2)) + 1e-7
                # cos >= t: the unit coordinate lies within half of t*q_f, or beyond it towards q_f.
                lo = np.where(qu[focus] >= t, qu[focus] * t - half, np.minimum(qu[focus] * t, qu[focus]) - half)
                hi = np.maximum(qu[focus] * t, qu[focus]) + half
                a = np.array([np.searchsorted(sorted_unit[:, f], x, "left") for f, x in zip(focus, lo)])
                b = np.array([np.searchsorted(sorted_unit[:, f], x, "right") for f, x in zip(focus, hi)])
                f = int(np.argmin(b - a))
                rows = by[a[f] : b[f], focus[f]]
                rows = rows[((unit[rows][:, focus] >= lo) & (unit[rows][:, focus] <= hi)).all(axis=1)]
                if len(rows):
                    s = products(q[r : r + 1], part[rows])
                    ids = v_ids[low:high][rows]
                    best.add(np.array([r]), s, ids, (ids != q_ids[r])[None, :] & (s >= bound[r]))
        low = high
    return best


def grid(embeddings: DataFrame, k: int = TOP, every: int = 50) -> tuple[DataFrame, DataFrame]:
    """Queries with their bounds, and vectors, by cell (a, g, h): query block, length group, shard of the group."""
    spark = embeddings.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    vectors = quantized(embeddings).withColumn("length", length)
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    cuts = F.percentile_approx("length", [i / GROUPS for i in range(1, GROUPS)], 10_000).alias("cuts")
    facts = vectors.agg(F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), cuts).first()
    across, bounds = max(1, -(-facts.q // CELL_QUERIES)), sorted(set(facts.cuts or []))
    vectors = vectors.withColumn("g", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("length"))) if bounds else F.lit(0))
    groups = [(r.g, r.n, r.longest) for r in vectors.groupBy("g").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()]  # at most GROUPS rows
    shards = F.create_map(*(F.lit(x) for g, n, _ in groups for x in (g, -(-n // CELL_VECTORS)))) if groups else F.create_map(F.lit(0), F.lit(1))
    seeds = spark.sparkContext.broadcast([(r.vec_id, r.v) for r in vectors.orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "v").collect()])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for i, v in seeds.value:
            by_size.setdefault(len(v), []).append((i, v))
        for batch in batches:
            for d, (q, ids) in _matrices(batch, "vec_id").items():
                own = by_size.get(d, [])
                floor = np.full(len(q), -np.inf)
                if own:
                    sv, si = np.array([v for _, v in own]), np.array([i for i, _ in own])
                    for at in range(0, len(q), 256):
                        best = search(q[at : at + 256], ids[at : at + 256], floor[at : at + 256], sv, si, k)
                        floor[at : at + 256] = best.bound()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(q), pa.list_(pa.float64())), pa.array(floor)], names=["vec_id", "v", "floor"])

    asked = written(asked.mapInArrow(tidy(seeded), "vec_id long, v array<double>, floor double").withColumn("length", length))
    # The grid: query block a meets shard h of the vectors of length group g in cell (a, g, h), if any of its queries can
    # reach its bound there.
    each = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(longest).alias("longest")) for g, _, longest in groups)) if groups else F.array(F.struct(F.lit(0).alias("g"), F.lit(0.0).alias("longest")))
    reached = F.filter(each, lambda x: ~(F.col("length") * x["longest"] * (1 + 1e-9) + 1e-6 < F.col("floor")))
    left = asked.select("vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.lit(across)).alias("a"), F.explode(F.transform(reached, lambda x: x["g"])).alias("g"))
    right = vectors.select("vec_id", "v", "g", F.pmod(F.xxhash64("vec_id", "v"), shards[F.col("g")]).cast("int").alias("h"))
    if across * len(groups) <= PAIRS_MOST:
        wanted = left.select(F.col("a").alias("block"), F.col("g").alias("group")).distinct()
        right = right.join(F.broadcast(wanted), F.col("g") == F.col("group")).select("vec_id", "v", "g", "h", F.col("block").alias("a"))
    else:
        right = right.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("a"))
    return left.select("*", F.explode(F.sequence(F.lit(0), (shards[F.col("g")] - 1).cast("int"))).alias("h")), right


def topk(embeddings: DataFrame, k: int = TOP, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors for each row whose vec_id is divisible by `every`."""

    def cell(key, qs: pa.Table, vs: pa.Table) -> pa.Table:
        got = [np.zeros(0, np.int64)] * 3
        if qs.num_rows and vs.num_rows:
            theirs = _matrices(vs, "vec_id")
            for d, (q, q_ids, floor) in _matrices(qs, "vec_id", "floor").items():
                if d in theirs:
                    best = search(q, q_ids, floor, *theirs[d], k)
                    r, c = np.nonzero(best.has)
                    got = [np.concatenate([x, y]) for x, y in zip(got, (q_ids[r], best.id[r, c], best.score[r, c]))]
        return pa.table(got, names=["query_id", "vec_id", "score"])

    left, right = grid(embeddings, k, every)
    found = left.groupBy("a", "g", "h").cogroup(right.groupBy("a", "g", "h")).applyInArrow(cell, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
