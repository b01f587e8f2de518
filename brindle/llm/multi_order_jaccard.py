"""Near copies by an n-gram Jaccard join with several global token orders.

A document's set is its distinct 5-word shingles. Two sets of a Jaccard
similarity of 0.8 or more share a token among the first n - ceil(0.8 n) + 1 of
each, whatever global order the tokens have. Order 0 puts tokens that many
documents share last, and candidates must share a prefix token in it (a join).
Then the prefixes under the orders 1 to ORDERS-1 (hash orders, tokens cut to 32
bits) and a bitmap of each candidate are fetched, a sixth of a set in all; pairs
must share a token under every order and pass the bitmaps' bound. Only of what all
filters leave are whole sets fetched and verified exactly.

Documents with the same set are one node. In a group of nodes with a common
prefix token, all are first compared with a leader, the node with the fewest
rarer tokens. Where that leaves a group in several components, the pairs across
components that pass the length and position filters are verified as well. So every pair that could be linked is verified, or lies in one
component already; no group is expanded into all its pairs.

Sets that are to be looked at are made anew from their texts. The texts are picked
by a bitmap of fixed size on their hashes, and where more are asked for than it
can tell apart, by a join on the hashes.

Shingles are compared by 64-bit hashes.

Defined cases: null and empty texts and texts without words have an empty set, no
links, and their own id as component; texts of fewer than five words are one
shingle; documents with the same doc_id count each and share their component as
far as their texts are linked; rows with a null doc_id link like others, and only
the smallest id leaves them out; extra columns are ignored by `near_copies` and kept by `first_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UNSPACED, discard, for_texts, mix, span_hashes, steps, text_buffers, tidy, word_spans, written
from .components import components

WORDS = 5
ORDERS = 3
#: Tokens in at least LOCAL nodes of a stretch of rows and GLOBAL over all stretches go last in order 0; MOST of them are
#: sent to executors. A stretch is a task's rows, up to COUNTED tokens.
LOCAL, GLOBAL, MOST, COUNTED = 2, 6, 400_000, 6_000_000
BLOCK_BYTES = 8 << 20
SPREAD = 64  # parts that the rows of a heavy token are dealt to
FILTER_BITS, FILTER_MOST = 24, 1 << 21  # of the bitmap of texts whose sets are needed, and bits set up to which it is used
_SEED = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, laid end to end, and n+1 offsets."""
    data, at = text_buffers(text)
    n, data = len(at) - 1, LOWER[data]
    s, e, row = word_spans(data, at, UNSPACED)
    h = span_hashes(data, s, e)
    count = np.bincount(row, minlength=n) if len(s) else np.zeros(n, np.int64)
    begin = np.cumsum(count) - count
    full = np.maximum(count - WORDS + 1, np.minimum(count, 1))
    start = np.repeat(begin - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
    owner = np.repeat(np.arange(n), full)
    x = np.full(len(start), 0x51ED270B, np.uint64)
    for k in range(WORDS):
        inside = k < count[owner]
        x = np.where(inside, mix(x * _SEED[k] ^ h[np.minimum(start + k, max(0, len(h) - 1))]) if len(h) else x, x)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[new], owner[new]
    return x, np.searchsorted(owner, np.arange(n + 1))


def node_ids(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set: equal sets, equal names."""
    n = len(at) - 1
    out = mix(np.diff(at).astype(np.uint64) + np.uint64(77))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        y = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        out[some] ^= mix(np.add.reduceat(y, at[some]))
    return out.view(np.int64) if n else np.zeros(0, np.int64)


def least_common(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n shares with any linked one: ceil(0.8 n)."""
    return (80 * n + 99) // 100


def _sets(docs: DataFrame, id_type: str) -> DataFrame:
    """For each row doc_id, n, node and a hash h of its text; and of each stretch of rows the tokens of LOCAL nodes or more with their number."""

    def often(parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        token, number = np.unique(np.concatenate(parts), return_counts=True)
        many = number >= LOCAL
        k = int(many.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, kind), pa.array(number[many]), pa.array(token[many].view(np.int64)), pa.nulls(k, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, set()
        kind = None
        for batch in steps(batches, most=BLOCK_BYTES):
            x, at = shingles(batch.column(1))
            node, n = node_ids(x, at), np.diff(at)
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n), pa.array(node), batch.column(2)], names=names)
            new = np.zeros(len(n), bool)
            for i, one in enumerate(node.tolist()):
                if one not in seen:
                    seen.add(one)
                    new[i] = True
            parts.append(x[np.repeat(new, n)])
            size += len(parts[-1])
            if size > COUNTED:
                yield often(parts, kind)
                parts, size, seen = [], 0, set()
        if parts:
            yield often(parts, kind)

    names = ["kind", "doc_id", "n", "node", "h"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(tidy(run), f"kind int, doc_id {id_type}, n long, node long, h long")


def ordered_prefix(x: np.ndarray, at: np.ndarray, heavy: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order 0: the prefix tokens of each set with their owner, place, and whether they are heavy."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(x), np.int64)
    if len(heavy):
        k = np.minimum(np.searchsorted(heavy, x), len(heavy) - 1)
        rank = np.where(heavy[k] == x, weight[k], 0)
    late = np.flatnonzero(rank)
    order = np.arange(len(x))
    if len(late):  # sets are sorted by hash already; only those with heavy tokens change
        touched = np.zeros(len(n), bool)
        touched[owner[late]] = True
        at_ = np.flatnonzero(touched[owner])
        order[at_] = at_[np.lexsort((x[at_], rank[at_], owner[at_]))]
    place = np.arange(len(x)) - at[owner]
    keep = place < (n - least_common(n) + 1)[owner]
    return x[order[keep]], owner[keep], place[keep], rank[order[keep]] > 0


def _postings(docs: DataFrame, heavy: np.ndarray, weight: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((heavy, weight))  # at most MOST tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=BLOCK_BYTES):
            x, at = shingles(batch.column(0))
            node = node_ids(x, at)
            _, one = np.unique(node, return_index=True)
            pick = np.zeros(len(node), bool)
            pick[one] = True
            n = np.diff(at)
            x = x[np.repeat(pick, n)]
            node, n = node[pick], n[pick]
            token, owner, place, often = ordered_prefix(x, np.concatenate([[0], np.cumsum(n)]), *sent.value)
            for low in range(0, len(token), 1 << 16):
                own = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(token[own].view(np.int64)), pa.array(node[owner[own]]), pa.array(n[owner[own]] << 32 | place[own]), pa.array(often[own])], names=["token", "node", "place", "often"])

    return docs.select("text").mapInArrow(tidy(run), "token long, node long, place long, often boolean")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node, one for each pair of them: those whose token another node has too, and all of
    heavy tokens. A row waits for at most one other."""
    kept, last = None, None  # a row that may yet turn out to be shared; token, node and whether shared of the last row
    for batch in batches:
        rows = batch if kept is None else pa.concat_batches([kept, batch])
        token, node, often = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(3).to_numpy(zero_copy_only=False)
        if not len(token):
            continue
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        head = np.append(True, token[1:] != token[:-1])
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(token)) - 1
        several = node[start] != node[end]
        if last is not None and last[0] == token[0]:  # the first token goes on from the batch before
            several[0] |= last[2] or last[1] != node[0]
            new[0] &= last[1] != node[0] or kept is not None
        keep = new & (often | several[np.cumsum(head) - 1])
        yield rows.filter(pa.array(keep)).select(["token", "node", "place"])
        waits = not several[-1] and not often[-1]
        kept, last = (rows.slice(start[-1], 1) if waits else None), (token[-1], node[-1], bool(several[-1]))


def _of_nodes(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, whole: bool) -> DataFrame:
    """node, n and set of the nodes in pairs, as a table: the sorted tokens if whole, else the parity bitmap and `prefixes`
    in the orders 1 to ORDERS-1. They are made anew from one text each."""
    spark = docs.sparkSession
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("h").distinct()
    bit = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    words = asked.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    if int(np.bitwise_count(bitmap.view(np.uint64)).sum()) > FILTER_MOST:
        texts, bitmap = texts.join(asked.hint("merge"), "h", "left_semi"), None
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        for batch in steps(batches):
            if on is not None:
                h = batch.column(0).to_numpy()
                batch = batch.filter(pa.array((on[(h & ((1 << FILTER_BITS) - 1)) >> 6] >> (h & 63)) & 1 == 1))
            if batch.num_rows:
                x, at = shingles(batch.column(1))
                raw = x.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])] if whole else parity(x, at)
                first = [b""] * len(sets) if whole else prefixes(x, at)
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(x, at)), pa.array(np.diff(at)), pa.array(sets, pa.binary()), pa.array(first, pa.binary())], names=["node", "n", "set", "first"])

    made = written(texts.mapInArrow(tidy(run), "node long, n long, set binary, first binary").dropDuplicates(["node"]))
    sent.unpersist()
    return made


def prefixes(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The prefixes of each set in the orders 1 to ORDERS-1, as 32 bits of each token's rank."""
    n = np.diff(at)
    keep = n - least_common(n) + 1
    ranks = [(mix(x * _SEED[k + 5]) >> np.uint64(32)).astype(np.uint32) for k in range(1, ORDERS)]
    return [b"".join(np.partition(r[a:b], m - 1)[:m].tobytes() for r in ranks) if b > a else b"" for a, b, m in zip(at[:-1], at[1:], keep)]


def share_in_all(a: bytes, b: bytes) -> bool:
    """Whether two sets have a prefix token in common in every one of the orders 1 to ORDERS-1."""
    x, y = np.frombuffer(a, np.uint32).reshape(ORDERS - 1, -1), np.frombuffer(b, np.uint32).reshape(ORDERS - 1, -1)
    for p, q in zip(x, y):
        both = np.concatenate([np.unique(p), np.unique(q)])
        both.sort()
        if not (both[1:] == both[:-1]).any():
            return False
    return True


def parity(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap of each set: bit h is the parity of its tokens that hash to h. The number of bits is a power of two of
    about eight for each token."""
    h = mix(x * np.uint64(0xFF51AFD7ED558CCD))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        bits = 1 << max(9, int(8 * (b - a) - 1).bit_length())
        one = np.bincount((h[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(one.astype(np.uint8), bitorder="little").tobytes())
    return out


def may_be_similar(n: int, m: int, a: bytes, b: bytes) -> bool:
    """An upper bound: tokens of just one set flip at most one bit each, so the sets differ in as many tokens as their
    bitmaps in bits, at least. The longer bitmap is folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    apart = int(np.bitwise_count(x ^ y).sum())
    common = (n + m - apart) // 2
    return 100 * common >= 80 * (n + m - common)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of a table of pairs (a, b) those that are linked, as a table: filters first, then whole sets of what they leave."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, a, b, p, q = (batch.column(i).to_pylist() for i in range(2, 8))
            got = [share_in_all(p[i], q[i]) and may_be_similar(n[i], m[i], a[i], b[i]) for i in range(len(n))]
            yield batch.filter(pa.array(got, pa.bool_())).select(["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield batch.filter(pa.array(got, pa.bool_())).select(["a", "b"])

    for test in (filtered, exact):
        sets = _of_nodes(docs, pairs, nodes, test is exact)
        one, two = (sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}{c}") for x in ("n", "set", "first"))) for c in "ab")
        met = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "seta", "setb", "firsta", "firstb")
        left = written(met.mapInArrow(tidy(test), "a long, b long"))
        discard(pairs, sets)
        pairs = left
    return pairs


_N, _POS = "shiftright({}, 32)", "({} & 4294967295)"
_LENGTHS = f"5 * least({_N.format('x.place')}, {_N.format('y.place')}) >= 4 * greatest({_N.format('x.place')}, {_N.format('y.place')})"
_PLACES = f"9 * least({_N.format('x.place')} - {_POS.format('x.place')}, {_N.format('y.place')} - {_POS.format('y.place')}) >= 4 * ({_N.format('x.place')} + {_N.format('y.place')})"


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and h, a hash of the text, for every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = written(_sets(for_texts(docs), id_type))
    rows = found.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node", "h")
    nodes = written(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("h").alias("h")))
    heavy = found.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= GLOBAL).orderBy(F.desc("n"), "node").limit(MOST).toArrow()
    token, weight = heavy.column("node").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
    order = np.argsort(token)
    # One shuffle brings the rows of a token together; those of heavy tokens are spread, as they are known to be shared.
    postings = _postings(docs, token[order], weight[order])
    dealt = postings.repartition(F.col("token"), F.when(F.col("often"), F.xxhash64("node") % SPREAD).otherwise(0)).sortWithinPartitions("token", "node")
    shared = written(dealt.mapInArrow(tidy(_shared), "token long, node long, place long").groupBy("token", "node").agg(F.min("place").alias("place")))
    # Every node of a group against its leader.
    lead = written(shared.groupBy("token").agg(F.min(F.struct(F.expr(_POS.format("place")).alias("p"), "node", "place")).alias("c"), F.count("*").alias("size")).where("size > 1"))
    leaders = lead.select("token", F.col("c.node").alias("lead"), F.col("c.place").alias("place"))
    stars = shared.alias("x").join(leaders.alias("y"), F.expr(f"x.token = y.token and x.node <> y.lead and {_LENGTHS} and {_PLACES}"))
    pairs = stars.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = _verified(written(pairs), docs, nodes)
    roots = written(components(links))

    # Groups of three or more that are still in several components: pairs across them.
    placed = written(shared.join(lead.where("size > 2").select("token"), "token").join(roots, "node", "left").select("token", "node", "place", F.coalesce("root", "node").alias("root")))
    main = placed.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    open_ = written(placed.join(written(main.select("token", F.col("m.root").alias("main"))), "token"))
    across = open_.where("root <> main").alias("x").join(open_.alias("y"), F.expr(f"x.token = y.token and x.root <> y.root and (y.root = y.main or x.node < y.node) and {_LENGTHS} and {_PLACES}"))
    more = written(across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    discard(shared, lead, placed, open_)
    if more.take(1):
        more = _verified(more, docs, nodes)
        both = written(links.unionByName(more))
        discard(roots)
        roots = written(components(both))
        discard(both)
    discard(links, more)

    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = written(named.groupBy("root").agg(F.min("first").alias("component_id")))
    of_node = written(named.join(ids, "root").select("node", "component_id"))
    discard(roots, nodes, ids)
    out = rows.where("n_shingles > 0").join(of_node, "node").select("doc_id", "n_shingles", "component_id", "h")
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "h"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return _placed(docs).select("doc_id", "n_shingles", "component_id")


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component. Rows with a null id, or a null or empty text, stay,
    and so do all rows that repeat the smallest id. Where an id repeats with different texts, only the linked ones go."""
    gone = _placed(docs).where("component_id is not null and doc_id is not null and component_id <> doc_id")
    gone = gone.select(F.col("doc_id").alias("__brindle_id"), F.col("h").alias("__brindle_h")).distinct()
    kept = docs.join(gone, (docs["doc_id"] == F.col("__brindle_id")) & (F.xxhash64(docs["text"]) == F.col("__brindle_h")), "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
