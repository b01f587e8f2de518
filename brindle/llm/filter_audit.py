"""Audit of how five quality filters interact, in every order in which they could be applied.

Each task reads its texts once: it tells which of the filters on a text alone fail, and keeps the smallest id of each
distinct text it has seen, so of a hot group of copies a task hands on one. Texts are then routed by xxhash64: a
partition keeps a chain for each hash, with the full text and the smallest id of every text in it, and emits all ids
that turn out not to be the smallest. What leaves this step is a narrow row (id, part, mask of failed filters) for each
document; labels are joined there, and `combineByKey` adds them up to 32 counts a part, in the tasks first. All
120 orders follow from these counts.

Defined cases: null text is empty, null source is the empty part. A null id is compared with no other, so such a row
never fails E and has no label. Rows that repeat an id and text all stay or all fail together: only a smaller id counts.
A row of a repeated id with another text is judged with that text. Labels that repeat an id count if any row says 1.
An empty text has no words: A fails, B and C don't. An empty table gives no rows; empty labels give zeros. A text of any length is
one record. Extra columns are ignored. A partition holds about `HELD` bytes of distinct texts, or one longer text.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_texts

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT = 65  # in 100 words
CAPITALS = 5  # in 100 code points
SIGNS = b"#$%&*|"

#: Bytes of distinct texts: of a routed partition, and that a task holds before it hands them on.
HELD = 32 << 20
SEEN = 16 << 20

_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))  # UTF-8 bytes that begin no code point
_COPY = 1 << FILTERS.index("E")


def failed(text: bytes) -> int:
    """The mask of the filters A to D that a UTF-8 text fails; bytes.split() cuts at just \\x20 and \\x09-\\x0D."""
    words = text.split()
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > CAPITALS * len(text.translate(None, _FOLLOWING))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return few | dull << 1 | loud << 2 | signs << 3


class _Smallest:
    """Of one text: the smallest id so far, and the parts of the rows that have it."""

    __slots__ = ("text", "doc_id", "parts", "mask")

    def __init__(self, text: bytes, doc_id: int, parts: Counter, mask: int) -> None:
        self.text, self.doc_id, self.parts, self.mask = text, doc_id, parts, mask

    def add(self, doc_id: int, parts: Counter) -> Iterator[tuple]:
        """Rows of one more id; gives out those that are no longer, or not, the smallest."""
        if doc_id == self.doc_id:
            self.parts.update(parts)
            return
        if doc_id < self.doc_id:
            doc_id, parts, self.doc_id, self.parts = self.doc_id, self.parts, doc_id, parts
        for part, n in parts.items():
            yield doc_id, part, self.mask | _COPY, n


def _seen(rows: Iterable[tuple], most: int = SEEN) -> Iterator[tuple]:
    """(doc_id, hash, text, part) -> (hash, smallest of a text), and (any number, a narrow row) for all others."""
    held: dict[bytes, tuple[int, _Smallest]] = {}
    size, turn = 0, 0
    for doc_id, code, text, part in rows:
        text = bytes(text)
        if doc_id is not None and text in held:
            done = held[text][1].add(doc_id, Counter({part: 1}))
        elif doc_id is not None:
            held[text], size, done = (code, _Smallest(text, doc_id, Counter({part: 1}), failed(text))), size + len(text), ()
        else:
            done = ((None, part, failed(text), 1),)
        for row in done:
            turn += 1  # narrow rows of a hot text go to all partitions in turn
            yield code + turn, row
        if size >= most:
            yield from held.values()
            held, size = {}, 0
    yield from held.values()


def _chained(records: Iterable[tuple]) -> Iterator[tuple]:
    """Narrow rows of a partition's texts, which are all that have their hash."""
    chains: dict[int, list[_Smallest]] = {}
    for code, found in records:
        if isinstance(found, tuple):
            yield found
            continue
        chain = chains.setdefault(code, [])
        same = next((x for x in chain if x.text == found.text), None)
        if same is None:
            chain.append(found)
        else:
            yield from same.add(found.doc_id, found.parts)
    for chain in chains.values():
        for x in chain:
            for part, n in x.parts.items():
                yield x.doc_id, part, x.mask, n


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit i: filter FILTERS[i] fails) and n, the number of rows that this row stands for."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = for_texts(documents.select(F.col("doc_id").cast("long"), "text", F.coalesce("source", F.lit("")).alias("part")))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routed = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // HELD))
    seen: RDD = rows.select("doc_id", F.xxhash64(text), text, "part").rdd.mapPartitions(_seen)
    narrow = seen.partitionBy(routed, _as_it_is).mapPartitions(_chained)
    return spark.createDataFrame(narrow, "doc_id long, part string, mask int, n long", verifySchema=False)


def _as_it_is(code: int) -> int:
    return code


def _vector(row: tuple) -> np.ndarray:
    return _added(np.zeros((3, 1 << len(FILTERS)), np.int64), row)


def _added(counts: np.ndarray, row: tuple) -> np.ndarray:
    """counts (all, good, toxic by mask) with one more row (mask, n, good, toxic)."""
    mask, n, good, toxic = row
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


def counted(documents: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts by mask of all, good and toxic documents) for every part."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    joined = failures(documents).join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    keyed = joined.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(_vector, _added, np.add)


def effects(counts: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step.

    In 120 orders, each of the k filters that a document fails comes before the other k - 1 in 120 / k."""
    total, good, toxic = counts
    masks = np.arange(1 << len(FILTERS))
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    fails = {f: masks >> i & 1 == 1 for i, f in enumerate(FILTERS)}
    k = sum(fails.values())
    share = np.where(k > 0, len(orders) // np.maximum(k, 1), 0)
    for order in orders:
        here = np.ones(len(masks), bool)
        for step, f in enumerate(order, 1):
            goes, late = here & fails[f], ~here & fails[f]
            here = here & ~fails[f]
            yield (
                order, step, int(total[here].sum()), int(total[goes].sum()), int(total[late].sum()), int(total[fails[f] & (k == 1)].sum()),
                int(good[goes].sum()), int(toxic[goes].sum()), int((total * share)[fails[f]].sum()),
            )


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part, order of the filters and step."""
    rows = counted(documents, labels).flatMap(lambda x: ((x[0], *row) for row in effects(x[1])))
    return documents.sparkSession.createDataFrame(rows, SCHEMA, verifySchema=False)
