"""Benchmark decontamination by suffix arrays over the training documents.

Each step of documents (a shard) is turned into word codes and one suffix array
is built over them. Every suffix of every benchmark item is then binary-searched
in it, packed words at a time, which gives the range of document places where its
next `WINDOW` words stand (all its words, if the item has fewer). A document is
contaminated if there is such a place in it. A match starts where the words before
differ, and is followed to its end once, so an item of any length that stands in a
document as a whole costs time in proportion to its length. Places and items that
share text (a template, a license) are followed together as nodes of a tree, so their
pairs are not made; documents that hold the same sets of items share one digest. The
list of ids that `found_in` tells by default is as long as the items a text holds.

A benchmark above `BLOCK_BYTES` is searched block by block: one map pass over the
documents for each, whose finds are written by a hash of the text and joined in the
end. The driver and the executors hold one block at a time.

Defined cases: null or empty text and texts without words have no words and no
hits; an item with null id or without words takes no part; items that repeat an
id count once; rows that repeat are each judged alone; an empty benchmark leaves
all documents clean; of longest matches of equal length the one of the smallest
item id (as a string) and then the first place is told. Extra columns are passed
through by `decontaminate` and never clash: own columns there start with
`__brindle_`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, discard, for_texts, steps, text_buffers, tidy, word_codes, word_spans, written

WINDOW = 10
#: Bytes of benchmark text held at a time (in expectation; an item is never cut); a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.IntegerType())),  # word places: start, end, start, end ...
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("n_items", T.LongType()),  # these two where ids are asked for as a digest, instead of the list
    T.StructField("items_sha256", T.StringType()),
    T.StructField("longest", T.IntegerType()),  # words of the longest verbatim match of a window's length or more
    T.StructField("longest_at", T.IntegerType()),  # its first word's place in the document
    T.StructField("longest_item", T.StringType()),
])
_FOUND = pa.struct([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string()),
])

#: Pairs of a place and an item suffix are followed one by one up to so many for each place and suffix.
PAIRS = 16


class SuffixArray:
    """Places of an integer sequence, sorted by the `depth` elements from each, which are kept as columns of packed keys."""

    def __init__(self, seq: np.ndarray, alphabet: int, depth: int):
        self.bits = max(1, int(alphabet).bit_length())
        self.per = max(1, 62 // self.bits)
        n, columns = len(seq), -(-depth // self.per)
        padded = np.concatenate([seq, np.zeros(columns * self.per, np.int64)])
        first = self.packed(padded, np.arange(n))
        order = np.argsort(first, kind="stable")
        self.order, self.keys = order, [first[order]]
        same = np.append(False, self.keys[0][1:] == self.keys[0][:-1])[:n]
        for c in range(1, columns):
            key = self.packed(padded, order + c * self.per)
            tied = same.copy()
            tied[:-1] |= same[1:]
            at = np.flatnonzero(tied)
            if len(at):  # only ties are sorted again
                again = np.lexsort((key[at], np.cumsum(~same)[at]))
                for x in (order, key, *self.keys[1:]):
                    x[at] = x[at][again]
            same &= np.append(False, key[1:] == key[:-1])[:n]
            self.keys.append(key)

    def packed(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """`per` elements from each place as one integer."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.per):
            out = (out << self.bits) | seq[at + k]
        return out

    def find(self, test: np.ndarray, first: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix test[first:], the range of sorted places that go on with its first `need` elements."""
        padded = np.concatenate([test, np.zeros(len(self.keys) * self.per, np.int64)])
        for c, keys in enumerate(self.keys):
            take = np.clip(need - c * self.per, 0, self.per)
            spare = self.bits * (self.per - take)
            low = self.packed(padded, first + c * self.per) >> spare << spare
            high = low + (np.int64(1) << spare) - 1
            if c == 0:
                lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            else:
                deep = np.flatnonzero((take > 0) & (lo < hi))
                lo[deep], hi[deep] = bisect(keys, lo[deep], hi[deep], low[deep], False), bisect(keys, lo[deep], hi[deep], high[deep], True)
        return lo, np.maximum(lo, hi)


def bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted in a sorted range of its own for each target."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        less = keys[mid] <= target[open_] if right else keys[mid] < target[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of each range low..high, laid end to end, and the range of each."""
    count = high - low
    whose = np.repeat(np.arange(len(low)), count)
    return np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + low[whose], whose


class Items:
    """Words of a block of benchmark items, and the suffixes to be searched."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.ids, self.window = ids, window
        self.data = LOWER[np.frombuffer(b"".join(raw), np.uint8)] if raw else np.zeros(0, np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.s, self.e, self.row = word_spans(self.data, self.at, ALNUM)
        counts = np.bincount(self.row, minlength=len(raw)) if len(self.s) else np.zeros(len(raw), np.int64)
        self.ends = np.cumsum(counts)  # of each item, in words
        stops = self.ends[self.row] if len(self.s) else self.s
        left = stops - np.arange(len(self.s))
        need = np.minimum(window, counts[self.row]) if len(self.s) else left
        self.from_, self.stop, self.need = np.flatnonzero(left >= need), stops, need
        _, self.rank = np.unique(np.array(ids, object).astype(str), return_inverse=True) if ids else (None, np.zeros(0, np.int64))  # items of one id rank alike


def listed(names: list[str]) -> dict:
    return {"items": names}


def digested(names: list[str]) -> dict:
    """In place of the ids: their number and the SHA-256 of them, comma-joined."""
    return {"n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()}


def untold(names: list[str]) -> dict:
    return {}


def scan_step(text: pa.Array, items: Items, tell: Callable[[list[str]], dict] = listed) -> list[dict]:
    """What a benchmark block has in each text: hit places as flat start-end pairs, longest match, and what `tell` makes
    of the item ids in order."""
    data, at = text_buffers(text)
    n, low = len(text), LOWER[data]
    s, e, row = word_spans(low, at, ALNUM)
    words = np.bincount(row, minlength=n) if len(s) else np.zeros(n, np.int64)
    none = tell([])
    found = [{"n_words": w, "hits": [], **none, "longest": 0, "longest_at": None, "longest_item": None} for w in words.tolist()]
    m = len(items.s)
    if not m or not len(s):
        return found
    # One dictionary for items and documents; 0 stands after each document and matches nothing.
    both = np.concatenate([items.data, low])
    codes, kinds = word_codes(both, np.concatenate([items.s, s + len(items.data)]), np.concatenate([items.e, e + len(items.data)]))
    codes += 1
    test = codes[:m]
    seq = np.zeros(len(s) + n, np.int64)
    seq[np.arange(len(s)) + row] = codes[m:]
    owner, start_of = np.repeat(np.arange(n), words + 1), np.cumsum(words + 1) - words - 1
    array = SuffixArray(seq, len(kinds), items.window)
    lo, hi = array.find(test, items.from_, items.need[items.from_])
    met = np.flatnonzero(hi > lo)
    if not len(met):
        return found
    w, need, lo, hi = items.from_[met], items.need[items.from_[met]], lo[met], hi[met]
    # A window is a distinct range and length; g: the window of each item place.
    _, one, g = np.unique(lo * (items.window + 1) + need, return_index=True, return_inverse=True)
    place, window = spread(lo[one], hi[one])
    p, size = array.order[place], need[one][window]
    _mark(found, p, size, owner, start_of)
    _name(found, items, owner[p], window, items.rank[items.row[w]], g, tell)
    _lengthen(found, items, test, seq, p, size, window, w, g, owner, start_of)
    return found


def _mark(found: list[dict], p: np.ndarray, size: np.ndarray, owner: np.ndarray, start_of: np.ndarray) -> None:
    """Sets `hits`: the maximal ranges of words inside any window."""
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, p, 1)
    np.add.at(change, p + size, -1)
    inside = np.cumsum(change) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):  # ranges end at their document's 0
        d = owner[a]
        found[d]["hits"] += [int(a - start_of[d]), int(b - start_of[d])]


def _name(found: list[dict], items: Items, doc: np.ndarray, window: np.ndarray, rank: np.ndarray, g: np.ndarray, tell: Callable[[list[str]], dict]) -> None:
    """Sets what `tell` makes of a text's item ids. Windows of the same items count as one, so a long shared passage is looked at once a document."""
    k = len(items.ids)
    pairs = np.unique(g * k + rank)
    begin = np.searchsorted(pairs // k, np.arange(int(g.max()) + 2))
    of = [tuple((pairs[a:b] % k).tolist()) for a, b in zip(begin[:-1], begin[1:])]
    number = {x: i for i, x in enumerate(dict.fromkeys(of))}
    sets, kind = list(number), np.array([number[x] for x in of])
    names = dict(zip(items.rank.tolist(), items.ids))
    kinds: dict[int, list[int]] = {}
    for key in np.unique(doc * len(sets) + kind[window]).tolist():
        kinds.setdefault(key // len(sets), []).append(key % len(sets))
    told: dict[tuple[int, ...], dict] = {}  # documents with the same sets share one result; a set inside another adds nothing
    as_sets = [frozenset(x) for x in sets]
    for d, of_doc in kinds.items():
        held: list[int] = []
        for x in sorted(of_doc, key=lambda x: (-len(sets[x]), x)):
            if not any(as_sets[x] <= as_sets[y] for y in held):
                held.append(x)
        if (key := tuple(held)) not in told:
            told[key] = tell([names[r] for r in sorted({r for x in held for r in sets[x]})])
        found[d] |= told[key]


def _lengthen(found: list[dict], items: Items, test: np.ndarray, seq: np.ndarray, p: np.ndarray, size: np.ndarray, window: np.ndarray, w: np.ndarray, g: np.ndarray, owner: np.ndarray, start_of: np.ndarray) -> None:
    """Sets the longest match. It begins at a window whose predecessors differ; only those are followed."""
    # The window at each document place and each item place; shorter items have one window each and no neighbours.
    full = size == items.window
    at_doc = np.full(len(seq) + 1, -1)
    at_doc[p[full]] = window[full]
    at_item = np.full(len(test) + 1, -1)
    at_item[w] = g
    before = np.where((w > 0) & (items.row[w] == items.row[w - 1]), at_item[w - 1], -1)
    order = np.lexsort((before, g))
    w, g, before = w[order], g[order], before[order]
    previous = np.where(full, at_doc[p - 1], -1)  # of place 0: the spare last slot, -1
    keys = g * (int(g.max()) + 2) + before + 1
    base = window * (int(g.max()) + 2)
    low, high = np.searchsorted(g, window, "left"), np.searchsorted(g, window, "right")
    skip_low = np.where(previous >= 0, np.searchsorted(keys, base + previous + 1, "left"), high)
    skip_high = np.where(previous >= 0, np.searchsorted(keys, base + previous + 1, "right"), high)
    # Pairs are made for the windows where they are few for the number of their places; the others go down a tree, with
    # all their suffixes: those that also agree in the word before only add shorter matches.
    each = np.maximum(0, skip_low - low) + np.maximum(0, high - skip_high)
    windows = int(g.max()) + 1
    there = np.bincount(g, minlength=windows)
    few = (np.bincount(window, each, windows) <= PAIRS * (np.bincount(window, each > 0, windows) + there))[window]
    i, whose = spread(np.concatenate([low[few], skip_high[few]]), np.concatenate([skip_low[few], high[few]]))
    whose = np.flatnonzero(few)[whose % max(1, int(few.sum()))]
    open_ = np.flatnonzero(~few & (each > 0))
    _, first, at_node = np.unique(window[open_], return_index=True, return_inverse=True)
    down = Descent(items, test, seq, w, p[open_], size[open_], at_node, *spread(low[open_][first], high[open_][first]))
    start, place, length = (np.concatenate(x) for x in zip((w[i], p[whose], size[whose].astype(np.int64)), down.pairs()))
    stop, live, reach = items.stop[start], np.arange(len(start)), 4
    test, seq = np.concatenate([test, np.zeros(1, np.int64)]), np.concatenate([seq, np.zeros(1, np.int64)])
    while len(live):  # ever longer stretches of what goes on
        step = np.arange(reach)
        a = np.minimum(start[live, None] + length[live, None] + step, len(test) - 1)
        b = np.minimum(place[live, None] + length[live, None] + step, len(seq) - 1)
        equal = (test[a] == seq[b]) & (a < stop[live, None])
        equal = np.logical_and.accumulate(equal, axis=1)
        length[live] += equal.sum(axis=1)
        live = live[equal[:, -1]]
        reach = min(2 * reach, max(4, (1 << 20) // max(1, len(live))))
    rank = np.concatenate([items.rank[items.row[start]], *down.ranks])
    place, length = np.concatenate([place, *down.places]), np.concatenate([length, *down.lengths])
    doc = owner[place]
    best = np.lexsort((place, rank, -length, doc))
    best = best[np.append(True, doc[best][1:] != doc[best][:-1])]
    names = dict(zip(items.rank.tolist(), items.ids))
    for d, k, r, x in zip(doc[best].tolist(), length[best].tolist(), rank[best].tolist(), place[best].tolist()):
        found[d] |= {"longest": k, "longest_at": int(x - start_of[d]), "longest_item": names[r]}


class Descent:
    """Places and item suffixes that begin alike, as nodes of a tree that is walked down word by word. Each place and each
    suffix is in one node at a time, so a step costs their number, however many pairs they make. A node with few pairs
    for its size leaves the tree as pairs; a place that no suffix goes on with is told at the length reached."""

    def __init__(self, items: Items, test: np.ndarray, seq: np.ndarray, w: np.ndarray, place: np.ndarray, size: np.ndarray, at: np.ndarray, i: np.ndarray, node: np.ndarray):
        self.items, self.test, self.seq = items, np.append(test, 0), np.append(seq, 0)
        self.place, self.length, self.at = place, size.astype(np.int64), at  # of places
        self.start, self.node = w[i], node  # of suffixes, sorted by node
        self.words = int(max(test.max(initial=0), seq.max(initial=0))) + 1
        self.ranks: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix starts, places and equal words so far, still to be followed; the rest is in ranks, places and lengths."""
        out = [(self.start[:0], self.place[:0], self.length[:0])]
        while len(self.place):
            nodes = int(self.at.max()) + 1
            there, here = np.bincount(self.node, minlength=nodes), np.bincount(self.at, minlength=nodes)
            few = there * here <= PAIRS * (there + here)
            low = np.searchsorted(self.node, np.arange(nodes), "left")
            alone = np.flatnonzero(few[self.at])
            i, whose = spread(low[self.at[alone]], (low + there)[self.at[alone]])
            out.append((self.start[i], self.place[alone[whose]], self.length[alone[whose]]))
            self._keep(~few[self.at], ~few[self.node])
            if len(self.place):
                self._down()
        return tuple(np.concatenate(x) for x in zip(*out))

    def _keep(self, places: np.ndarray, suffixes: np.ndarray) -> None:
        self.place, self.length, self.at = self.place[places], self.length[places], self.at[places]
        self.start, self.node = self.start[suffixes], self.node[suffixes]

    def _down(self) -> None:
        """One word further: nodes split by the word that follows."""
        nodes = int(max(self.at.max(), self.node.max())) + 1
        depth, least = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max)
        depth[self.at] = self.length  # places of a node are alike so far, and so are its suffixes
        np.minimum.at(least, self.node, self.items.rank[self.items.row[self.start]])
        reach = self.start + depth[self.node]
        on = reach < self.items.stop[self.start]
        key = self.node[on] * self.words + self.test[reach[on]]
        keys, split = np.unique(key, return_inverse=True)
        want = self.at * self.words + self.seq[np.minimum(self.place + self.length, len(self.seq) - 1)]
        to = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        goes = keys[to] == want if len(keys) else np.zeros(len(want), bool)
        self.ranks.append(least[self.at[~goes]])
        self.places.append(self.place[~goes])
        self.lengths.append(self.length[~goes])
        order = np.argsort(split, kind="stable")
        self.start, self.node = self.start[on][order], split[order]
        self.place, self.length, self.at = self.place[goes], self.length[goes] + 1, to[goes]
        live = np.unique(self.at)  # nodes with a place in them go on, numbered anew
        number = np.full(len(keys) + 1, -1)
        number[live] = np.arange(len(live))
        self.node = number[self.node]
        self._keep(np.ones(len(self.at), bool), self.node >= 0)
        self.at = number[self.at]


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with id and text, as i and t."""
    return benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")


def _scanned(docs: DataFrame, block: list[tuple[str, str]], window: int, met_only: bool = False, tell: Callable[[list[str]], dict] = listed) -> tuple[DataFrame, object]:
    """docs with `__brindle_found` (FOUND) for a block, all rows or those with a hit; and the broadcast block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([i for i, _ in sent.value], [t for _, t in sent.value], window)
        for batch in steps(batches):
            got = scan_step(batch.column(batch.schema.get_field_index("text")), items, tell)
            if met_only:
                some = [k for k, x in enumerate(got) if x["hits"]]
                batch, got = batch.take(pa.array(some, pa.int64())), [got[k] for k in some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, _FOUND)], names=[*batch.schema.names, "__brindle_found"])

    return docs.mapInArrow(tidy(scan), T.StructType([*docs.schema.fields, T.StructField("__brindle_found", FOUND)])), sent


def found_in(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, tell: Callable[[list[str]], dict] = listed) -> DataFrame:
    """docs with `__brindle_found` (FOUND). One block: map-only. More: a pass for each, its finds written, then a join."""
    docs, items = for_texts(docs), _items(benchmark)
    number = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    if number == 1:
        return _scanned(docs, [tuple(r) for r in items.collect()], window, tell=tell)[0]
    tell = listed if tell is digested else tell  # ids of several blocks are put in order together
    key = docs.select(F.md5("text").alias("__brindle_key"), "text")
    parts = []
    for k in range(number):  # by a hash of the id, so the rows of one id are together
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(number)) == k).collect()]
        part, sent = _scanned(key, block, window, met_only=True, tell=tell)
        parts.append(written(part.select("__brindle_key", "__brindle_found").dropDuplicates(["__brindle_key"])))
        sent.destroy()
    f = F.col("__brindle_found")
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("__brindle_key").agg(
        F.flatten(F.collect_list(f["hits"])).alias("hits"), F.array_sort(F.flatten(F.collect_list(f["items"]))).alias("items"),
        F.max(f["longest"]).alias("longest"), F.collect_list(F.struct(f["longest"].alias("n"), f["longest_item"].alias("i"), f["longest_at"].alias("a"))).alias("each"),
    )
    best = F.array_min(F.filter("each", lambda x: x["n"] == F.col("longest")))
    every = written(every.select("__brindle_key", "hits", "items", "longest", best.alias("best")))
    discard(*parts)
    plain, _ = _scanned(docs.withColumn("__brindle_key", F.md5("text")), [], window)  # counts the words
    none = F.expr("named_struct('hits', cast(array() as array<int>), 'items', cast(array() as array<string>))")
    out = F.struct(
        F.col("__brindle_found.n_words").alias("n_words"), F.coalesce("hits", none["hits"]).alias("hits"), F.coalesce("items", none["items"]).alias("items"),
        F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"),
        F.coalesce("longest", F.lit(0)).alias("longest"), F.col("best.a").alias("longest_at"), F.col("best.i").alias("longest_item"),
    )
    return plain.join(every, "__brindle_key", "left").select(*(F.col(f"`{c}`") for c in docs.columns), out.alias("__brindle_found"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match with its place."""
    found = found_in(docs.select("doc_id", "text"), benchmark, window, block_bytes, digested)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            hit = [_covered(r["hits"]) for r in rows]
            told = [r if r["items_sha256"] else digested(sorted(set(r["items"]))) for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r["n_words"] for r in rows], pa.int64()), pa.array(hit, pa.int64()), pa.array([x["n_items"] for x in told], pa.int64()),
                pa.array([x["items_sha256"] for x in told], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
                pa.array([r["longest"] for r in rows], pa.int32()), pa.array([r["longest_at"] for r in rows], pa.int32()), pa.array([r["longest_item"] for r in rows], pa.string()),
            ], names=OUT.names)

    OUT = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()),
        ("longest_words", T.IntegerType()), ("longest_at", T.IntegerType()), ("longest_item", T.StringType())))])
    return found.select("doc_id", "__brindle_found").mapInArrow(tidy(digest), OUT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    found = found_in(docs, benchmark, window, block_bytes, untold)
    return found.where(F.size("__brindle_found.hits") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def _covered(pairs: list[int]) -> int:
    """Places inside any of the start-end pairs."""
    total, reach = 0, 0
    for a, b in sorted(zip(pairs[0::2], pairs[1::2])):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total
