"""Language ID by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ORDER-1 with method-C escapes,
counted once on a bounded sample and then frozen. A text's code length under a
language is the exact sum, over its bytes, of the cost of the byte in its longest
known context plus the escapes on the way there; a byte that even order 0 has not
seen costs the escape from there and eight bits, so the costs make a code. The
shortest code names the language.

Trees are held for GROUP languages at a time, so what is sent to executors and
the work for a text grow in proportion to the number of languages. What they learn
from is bounded for all languages together, and rows that repeat are learnt once.

Letters are lower-cased (A-Z) and all runs of other ASCII bytes become one space
before coding, so digits, marks and layout cost the same in every language.

Defined cases: a null text and one without a letter (Unicode category L) is `und`
with score 0, as is every text where nothing could be learned; ties go to the
smaller language name; repeated rows are predicted alike; extra columns are
passed through by `identify` or ignored by `predict`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, crc_text, discard, for_texts, steps, text_buffers, tidy, written

ORDER = 4  # bytes of the longest n-gram: contexts of up to three bytes
#: Training sample: rows of a language in expectation, and bytes of a language at most (rows in the order of a hash).
ROWS, BYTES = 1000, 6 << 20
TOTAL = 64 << 20  # bytes of all languages' samples; each has an even part of it where they are many
HASHES = 1 << 40  # hashes are told apart this finely, so that the sample keeps its size however many rows there are
#: Code points that training takes of a row: a stretch that begins at a place given by a hash.
STRETCH = 1 << 15
GROUP = 16  # languages whose trees share one table
#: The score is the posterior as if the text had this many bytes, so that long texts don't all score 1.
SCORE_BYTES = 40
#: A text is rejected if its best code needs more bits a byte than storing the bytes.
REJECT_BITS = 8.0

FOLD = LOWER.copy()
FOLD[:128][~np.isin(np.arange(128), np.arange(97, 123))] = 32
FOLD[65:91] = np.arange(97, 123)
PAD = ORDER - 1


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters lower-cased and other runs as one space; each text follows PAD spaces. Bytes and offsets."""
    n = len(at) - 1
    x = FOLD[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    first = at[:-1][np.diff(at) > 0]
    keep[first] = x[first] != 32
    counts = np.concatenate([[0], np.cumsum(keep)])[at]
    sizes = np.diff(counts) + PAD
    new = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.full(new[-1], 32, np.uint8)
    body = np.ones(new[-1], bool)
    body[(new[:-1][:, None] + np.arange(PAD)).ravel()] = False
    out[body] = x[keep]
    return out, new


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place from ORDER-1 on, as an integer."""
    size = len(x) - PAD
    out = np.zeros(max(0, size), np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | x[PAD - n + 1 + k : PAD - n + 1 + k + size]
    return out


class Slots:
    """Open addressing from 32-bit keys to row numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key, self.row = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self.hash(keys)
        while len(left):
            place = at[left]
            free = self.row[place] < 0
            _, one = np.unique(place, return_index=True)
            lucky = np.zeros(len(left), bool)
            lucky[one] = True
            lucky &= free
            self.row[place[lucky]], self.key[place[lucky]] = left[lucky], keys[left[lucky]]
            left = left[~lucky]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self.hash(keys)
        out = self.row[at]
        miss = np.flatnonzero((self.key[at] != keys) & (out >= 0))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            out[miss] = self.row[at[miss]]
            miss = miss[(self.key[at[miss]] != keys[miss]) & (out[miss] >= 0)]
        return out


class Model:
    """Frozen context trees of all languages, in groups."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.groups = [Trees([counted(texts[name]) for name in self.languages[low : low + GROUP]]) for low in range(0, len(self.languages), GROUP)]

    def bits(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each folded text in each language."""
        return np.concatenate([g.bits(x, at) for g in self.groups], axis=1) if self.groups else np.zeros((len(at) - 1, 0))


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to ORDER, the distinct grams that end with a byte of a text (not with padding) and their counts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    x, at = folded(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    body = np.ones(max(0, len(x) - PAD), bool)
    if len(at) > 2:
        body[(at[1:-1, None] - PAD + np.arange(PAD)).ravel()] = False
    return [np.unique(grams(x, k)[body], return_counts=True) for k in range(1, ORDER + 1)]


class Trees:
    """Frozen context trees of a few languages: one row for each gram that any of them has, one column for each language."""

    def __init__(self, counts: list[list[tuple[np.ndarray, np.ndarray]]]):
        n = len(counts)
        # Order by order: cost of each gram's last byte in the context before it, and the context's escape cost.
        # A text's first contexts are padding and end no gram, so the contexts of the next order are taken in as well.
        self.keys = [np.unique(np.concatenate([np.zeros(0, np.uint32), *(c[k][0] for c in counts), *(c[k + 1][0] >> np.uint32(8) for c in counts if k + 1 < ORDER)])) for k in range(ORDER)]
        self.keys[0] = np.arange(256, dtype=np.uint32)  # every byte can be coded
        self.slots = [Slots(keys) for keys in self.keys]
        self.cost, self.escape = [], []
        for k in range(ORDER):
            keys = self.keys[k]
            cost, escape = np.zeros((len(keys), n), np.float32), np.zeros((len(keys), n), np.float32)
            for j in range(n):
                seen, count = counts[j][k]
                context = seen >> np.uint32(8)
                _, group, kinds = np.unique(context, return_inverse=True, return_counts=True)
                total = np.bincount(group, count) + kinds if len(seen) else np.zeros(0)
                if k == 0:  # an escape from order 0, if the language has any byte, then one of all bytes
                    cost[:, j] = 8 + (np.log2(total[0] / kinds[0]) if len(seen) else 0)
                else:
                    cost[:, j] = self._lower(keys, k, j)
                if len(seen):
                    cost[np.searchsorted(keys, seen), j] = np.log2(total[group] / count)
            self.cost.append(cost)
            self.escape.append(escape)
            for j in range(n):  # what the grams of this order, as contexts, charge for an escape to their own order
                if k + 1 < ORDER:
                    seen, count = counts[j][k + 1]
                    context, group, kinds = np.unique(seen >> np.uint32(8), return_inverse=True, return_counts=True)
                    if len(seen):
                        total = np.bincount(group, count) + kinds
                        at = np.searchsorted(keys, context)
                        ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == context)
                        escape[at[ok], j] = np.log2(total / kinds)[ok]

    def _lower(self, keys: np.ndarray, k: int, j: int) -> np.ndarray:
        """Cost of each gram of order k in language j when its own context hasn't seen its last byte."""
        if k == 0:
            return self.cost[0][keys, j]
        context = self.slots[k - 1].find(keys >> np.uint32(8))
        charge = np.where(context >= 0, self.escape[k - 1][np.maximum(context, 0), j], 0)
        shorter = keys & np.uint32((1 << 8 * k) - 1)
        row = self.slots[k - 1].find(shorter)
        known = np.where(row >= 0, self.cost[k - 1][np.maximum(row, 0), j], 0)
        miss = row < 0
        if miss.any():
            known[miss] = self._lower(shorter[miss], k - 1, j)
        return charge + known

    def bits(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each folded text in each language."""
        n = len(at) - 1
        each = self.costs(grams(x, ORDER))
        # Row i of each codes byte i + PAD; the rows between two texts, which code padding, are left out.
        out = np.zeros((n, each.shape[1]))
        full = np.flatnonzero(np.diff(at) > PAD)
        if len(full):
            cuts = np.stack([at[full], at[full + 1] - PAD], axis=1).ravel()
            out[full] = np.add.reduceat(each, cuts[:-1], axis=0, dtype=np.float64)[::2]
        return out

    def costs(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), self.cost[0].shape[1]), np.float32)
        left = np.arange(len(key))
        for k in range(ORDER - 1, -1, -1):
            row = self.slots[k].find(key)
            hit = row >= 0
            out[left[hit] if len(left) < len(out) else hit] += self.cost[k][row[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            context = self.slots[k - 1].find(key >> np.uint32(8))
            has = context >= 0
            out[left[has]] += self.escape[k - 1][context[has]]
            key = key & np.uint32((1 << 8 * k) - 1)
        return out


def sample(docs: DataFrame, rows: int = ROWS) -> dict[str, list[str]]:
    """Training texts by language: of rows whose hash falls under each language's share, in the order of the hash. Rows
    that repeat count once, and bytes are bounded before anything reaches the driver: a language has at most BYTES, and
    its even part of TOTAL where there are many, and half as much again by its last row."""
    known = for_texts(docs).where(f"text is not null and lang is not null and {crc_text('doc_id')} % 5 != 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    per = written(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    number = per.count()
    if not number:
        discard(per)
        return {}
    most = max(1, min(BYTES, TOTAL // number))
    stretch = max(1, min(STRETCH, most // 8))  # code points, of four bytes at most
    share = per.select("lang", F.least(F.lit(HASHES), F.ceil(F.lit(HASHES * rows) / F.greatest("n", F.lit(1)))).alias("share"))
    cut = F.expr(f"substring(text, 1 + cast(pmod(h, greatest(1, length(text) - {stretch} + 1)) as int), {stretch})")
    picked = known.withColumn("part", F.pmod("h", F.lit(HASHES))).join(share, "lang").where("part < share").select("lang", "h", cut.alias("text")).dropDuplicates(["lang", "h"])
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    texts: dict[str, list[str]] = {}
    for r in picked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("lang", "h", "text").orderBy("lang", "h").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    discard(per)
    return texts


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    """Context trees from a bounded sample."""
    return Model(sample(docs, rows))


def has_letter(text: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    out = np.diff(ascii_[at]) > 0
    for i in np.flatnonzero(~out & (np.diff(wide[at]) > 0)):
        out[i] = any(c.isalpha() for c in text[int(i)].as_py())
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `__brindle_lang` (string), `__brindle_score` and `__brindle_bits` (bits a byte, null for `und`)."""
    sent = for_texts(docs).sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    added = [T.StructField("__brindle_lang", T.StringType()), T.StructField("__brindle_score", T.DoubleType()), T.StructField("__brindle_bits", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, "und"], object)
        for batch in steps(batches, most=(4 << 20) // min(GROUP, max(4, len(m.languages)))):
            text = batch.column(batch.schema.get_field_index("text"))
            data, at = text_buffers(text)
            letter = has_letter(text, data, at)
            pick, score, each = np.full(len(text), len(m.languages)), np.zeros(len(text)), np.full(len(text), np.nan)
            if len(m.languages):
                x, new = folded(data, at)
                bits, size = m.bits(x, new), np.maximum(1, np.diff(new) - PAD)
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(text)), best]
                odds = np.exp2(-(bits - low[:, None]) * np.minimum(1, SCORE_BYTES / size)[:, None])
                pick, score, each = np.where(letter, best, pick), np.where(letter, 1 / odds.sum(axis=1), 0.0), np.where(letter, low / size, np.nan)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[pick], pa.string()), pa.array(score), pa.array(each, mask=np.isnan(each))],
                names=[*batch.schema.names, *(f.name for f in added)],
            )

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.expr(f"{crc_text('doc_id')} % 5 = 0").alias("held_out"), F.col("__brindle_lang").alias("lang_pred"), F.col("__brindle_score").alias("score"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs with a language: not `und`, and no costlier than their bytes."""
    found = identify(docs, train(docs))
    return found.where((F.col("__brindle_lang") != "und") & (F.col("__brindle_bits") <= REJECT_BITS)).select(*(F.col(f"`{c}`") for c in docs.columns))
