"""Shared helpers: Arrow text buffers as numpy arrays, word spans, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard, written  # noqa: F401  (shared by all operators here)

#: Text bytes that one numpy step works on; a single longer text is a step of its own.
STEP_BYTES = 4 << 20

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words `[^\x20\x09-\x0D]+`.
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[[32, 9, 10, 11, 12, 13]] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings for rows that hold whole texts: setting -> (Spark's default, rows of a batch here). A batch of thousands of
#: texts takes tens of MB in the JVM and again in Python, several times over; these bound it without more files or tasks.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}


def for_texts(df: DataFrame) -> DataFrame:
    """df, in a session whose batches of rows are small enough for texts. What the caller has set stays."""
    for key, (default, value) in BATCHES.items():
        if df.sparkSession.conf.get(key, default) == default:
            df.sparkSession.conf.set(key, value)
    return df


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run for mapInArrow, giving free memory back to the system at its end: an idle Python worker, kept for the next
    task, otherwise holds what its largest step took."""

    def then_released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return then_released


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def crc_text(column: str) -> str:
    """SQL for crc32 of an id as text; a null id counts as an empty text."""
    return f"crc32(cast(coalesce(cast({column} as string), '') as binary))"


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` text bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with inside[byte], and the row of each; runs end with their row."""
    mask = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True  # of an empty last row this is the end; the slot is spare
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | first[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(at, s, "right") - 1


def word_codes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact dictionary codes of the words data[s:e] in order of first sight, and the words by code."""
    if not len(s):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    at = np.empty(2 * len(s), np.int32)
    at[0::2], at[1::2] = s, e
    both = pa.Array.from_buffers(pa.binary(), 2 * len(s) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    coded = both.take(pa.array(np.arange(0, len(both), 2, dtype=np.int32))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] from 8-byte pieces: mixed words of each span, summed by place."""
    out = np.full(len(s), 0x9E3779B97F4A7C15, np.uint64)
    if not len(s):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))
    live, at, left = np.arange(len(s)), s.astype(np.int64), (e - s).astype(np.int64)
    out ^= left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    while len(live):
        piece = np.ascontiguousarray(words[at]).view("<u8").ravel()
        piece &= KEEP[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ piece)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


#: Masks of the lowest n bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
