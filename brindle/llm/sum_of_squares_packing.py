"""Packing of tokenised documents into sequences of `MOST` tokens by the sum-of-squares rule.

With N(g) open bins that have g tokens left, the next piece goes where the sum of all N(g)^2 becomes smallest; a bin
is opened where no open one has room. Larger pieces come first. The state is one count for each gap, so the whole
packing needs the number of pieces of each length and nothing else: it is planned on the driver from at most `MOST`
counts, and bins are ranges of numbers there, not rows. Pieces of one length are placed in lots of at most 1 / `LOTS`
of them, so the plan's size has a bound that doesn't grow with the documents.

On Spark: one map pass tokenises whole texts and writes a narrow row for each piece; these are numbered in the order
of length (ranges of the order, no window over a whole length), and a second map pass looks each number up in the plan.
Texts are read once and never shuffled.

The tokenizer splits at white space and between letters, digits and signs, so a text's ids are those of its units in
order; distinct units are encoded once a step and kept, in bounded memory, for the tasks that follow in a worker.

Defined cases: null text is empty; an empty text is one piece that holds the end only. Rows that repeat, also with equal
or null ids, are each a document. Pieces of equal length are numbered by doc_id (null first), piece, start and checksum, so
ties between different rows are settled. An empty table gives no rows. A text of any length is encoded as a whole; its
units that aren't plain words are encoded by themselves. Special tokens spelled in a text are ordinary text. Extra
columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import LOWER, for_texts, steps, text_buffers, tidy, word_codes, written

MOST = 4096
END = 1
LOTS = 64

#: Text bytes of a step, and distinct units that a worker keeps.
STEP = 8 << 20
KEPT = 1_000_000


def default_vocabulary(spark: SparkSession) -> str:
    """The file named by the setting spark.brindle.word_tokenizer, or that of the installed public tokenizers."""
    given = spark.conf.get("spark.brindle.word_tokenizer", None)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- tokens

#: Kinds of bytes: 1 letter, 2 digit, 3 sign, 9 white space; 0 stays together with whatever stands beside it.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[[32, 9, 10, 11, 12, 13]] = 9
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the parts of texts that the tokenizer surely treats alone: between white space, between
    ASCII letters, digits and signs, and around every digit; but an apostrophe stays with the letter behind it, as in 're."""
    kind = KIND[data]
    begins = np.ones(len(data) + 1, bool)
    a, b = kind[:-1], kind[1:]
    begins[1:-1] = (a > 0) & (b > 0) & ((a != b) | (a == 2)) & ~((data[:-1] == 39) & (b == 1))
    begins[at] = True
    spaces = kind == 9
    begins[1:] |= spaces
    s = np.flatnonzero(begins)
    e = np.append(s[1:], len(data))
    s, e = s[s < len(data)], e[s < len(data)]
    text = ~spaces[s]
    s, e = s[text], e[text]
    return s, e, np.searchsorted(at, s, "right") - 1


class Encoder:
    """Ids of texts; keeps those of distinct units. Many units are encoded as one text with a digit between them, which is
    always a token of its own; those of lower-case ASCII letters by a copy of the tokenizer that leaves out normalising,
    which doesn't change them."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.words = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = self.words.encode_special_tokens = True
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.between,) = self.whole.encode("0", add_special_tokens=False).ids
        self.known, self.sizes, self.ids = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _joined(self, tokenizer, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of units without a 0, encoded as one text with " 0 " behind each."""
        data, at = text_buffers(found)
        n = len(found)
        out = np.full(len(data) + 3 * n, 32, np.uint8)
        out[spread(at[:-1] + 3 * np.arange(n), np.diff(at))] = data
        out[at[1:] + 3 * np.arange(n) + 1] = 48
        ids = np.array(tokenizer.encode_batch_fast([out.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        return np.diff(np.flatnonzero(ids == self.between), prepend=-1) - 1, ids[ids != self.between]

    def _alone(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for any units."""
        encoded = [e.ids for e in self.whole.encode_batch_fast([u.decode() for u in found.to_pylist()], add_special_tokens=False)]
        return np.array([len(x) for x in encoded], np.int64), np.array([y for x in encoded for y in x], np.uint32)

    def _new(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = text_buffers(found)
        none = lambda of: (x := np.concatenate([[0], np.cumsum(of)]))[at[1:]] == x[at[:-1]]
        words, zeros = none(~LETTERS[data]), ~none(data == 48)
        parts = [(words, lambda x: self._joined(self.words, x)), (~words & ~zeros, lambda x: self._joined(self.whole, x)), (zeros, self._alone)]
        done = [(of, *encode(found.filter(pa.array(of)))) for of, encode in parts if of.any()]
        sizes = np.zeros(len(found), np.int64)
        for of, size, _ in done:
            sizes[of] = size
        ids = np.zeros(int(sizes.sum()), np.uint32)
        for of, _, own in done:
            ids[np.repeat(of, sizes)] = own
        return sizes, ids

    def units(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of distinct units."""
        seat = pc.index_in(found, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = found.filter(pa.array(seat < 0))
        sizes, ids = self._new(fresh)
        seat[seat < 0] = len(self.known) + np.arange(len(fresh))
        all_sizes, all_ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        if len(self.known) < KEPT:
            few = KEPT - len(self.known)
            self.known = pa.concat_arrays([self.known, fresh.slice(0, few)])
            self.sizes, self.ids = all_sizes[: len(self.known)], all_ids[: int(all_sizes[: len(self.known)].sum())]
        starts = np.cumsum(all_sizes) - all_sizes
        return all_sizes[seat], all_ids[spread(starts[seat], all_sizes[seat])]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, each with END behind, and the n + 1 offsets of the texts."""
        data, at = text_buffers(column)
        after = np.append(data[1:], np.uint8(0))[: len(data)]
        low = np.where(after < 128, LOWER[data], data)  # before other bytes an accent may follow, which comes first
        s, e, row = units(low, at)
        codes, words = word_codes(low, s, e)
        sizes, ids = self.units(words)
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        n = len(at) - 1
        ends = upto[np.searchsorted(row, np.arange(n + 1))] + np.arange(n + 1)
        out = np.full(int(ends[-1]), END, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends[1:] - 1] = False
        out[inside] = ids[spread(starts[codes], each)]
        return out, ends


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ... starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


_ENCODERS: dict[str, Encoder] = {}  # of this worker


def _pieces_of(vocabulary: str, most: int):
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        encoder = _ENCODERS[vocabulary]
        for batch in steps(batches, most=STEP):
            ids, ends = encoder.encode(batch.column(1))
            n = np.diff(ends)
            count = -(-n // most)
            row, piece = np.repeat(np.arange(len(n)), count), spread(np.zeros(len(n), np.int64), count)
            start = piece * most
            length = np.minimum(most, n[row] - start)
            raw, begin = ids.astype("<u4").view(np.uint8), 4 * (ends[row] + start)
            crc = np.fromiter((zlib.crc32(raw[a : a + b]) for a, b in zip(begin, 4 * length)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], schema=kind)

    return tidy(run)


def pieces(documents: DataFrame, vocabulary: str | None = None, most: int = MOST) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of at most `most` tokens."""
    vocabulary = vocabulary or default_vocabulary(documents.sparkSession)
    texts = for_texts(documents.select(F.col("doc_id").cast("long"), "text"))
    return texts.mapInArrow(_pieces_of(vocabulary, most), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan


def plan(counts: dict[int, int], most: int = MOST, lots: int = LOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the number of pieces of each length: rows (length, first, bin, offset), sorted by the former two. The pieces
    first, first + 1, ... of a length, counted from 0, up to the next row's first, go to the bins bin, bin + 1, ... at
    that offset."""
    open_bins = np.zeros(most + 1, np.int64)  # by the tokens left; 0 isn't kept
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]  # bins with so much left: first, number
    out, bins = [], 0
    for s in sorted(counts, reverse=True):
        left, first, lot = counts[s], 0, -(-counts[s] // lots)
        while left:
            n = min(lot, left)
            gap = best_gap(open_bins, s, most)
            if gap is None:
                found, gap = [(bins, n)], most
                bins += n
            else:
                n = min(n, int(open_bins[gap]))
                open_bins[gap] -= n
                found, need = [], n
                while need:
                    low, size = ranges[gap].pop()
                    if size > need:
                        ranges[gap].append((low + need, size - need))
                        size = need
                    found.append((low, size))
                    need -= size
            for low, size in found:
                out.append((s, first, low, most - gap))
                first += size
            if gap > s:
                open_bins[gap - s] += n
                ranges[gap - s] += found
            left -= n
    rows = np.array(sorted(out), np.int64).reshape(-1, 4)
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def best_gap(open_bins: np.ndarray, s: int, most: int) -> int | None:
    """The gap of an open bin that makes the sum of squares smallest when s tokens go there (the smallest such gap)."""
    own = open_bins[s:most]
    if not own.any():
        return None
    then = open_bins[: most - s].copy()
    # (own - 1)^2 + (then + 1)^2 less what they were; a bin that gets full isn't counted any more
    change = 2 * (then - own) + 2
    change[0] = 1 - 2 * own[0]
    change[own == 0] = np.iinfo(np.int64).max
    return s + int(np.argmin(change))


def _seated(lengths: np.ndarray, firsts: np.ndarray, bins: np.ndarray, offsets: np.ndarray):
    keys = lengths << 48 | firsts
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    kind = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length << 48 | number, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins[at] + number - firsts[at]), pa.array(offsets[at])], schema=kind)

    return run


def packed(documents: DataFrame, vocabulary: str | None = None, most: int = MOST, lots: int = LOTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    cut = written(pieces(documents, vocabulary, most))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, most, lots)
    order = numbered(cut, ["length", "doc_id", "piece", "start", "ids_crc32"], "number")
    shorter, before = 0, []
    for length in sorted(counts):
        before.append((length, shorter + 1))
        shorter += counts[length]
    listed = [0] * (most + 1)  # by length: the number of its first piece
    for length, first in before:
        listed[length] = first
    start = F.split(F.lit(",".join(map(str, listed))), ",").cast("array<bigint>")
    own = F.col("number") - F.element_at(start, F.col("length").cast("int") + 1)
    seats = order.select("doc_id", "piece", "start", "length", "ids_crc32", own.alias("number"))
    return seats.mapInArrow(_seated(*rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
