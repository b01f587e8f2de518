"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its character n-grams (with word
ends); a text's is the mean over its words, those without any known n-gram left
out; a softmax over a linear layer gives the probability. A misspelling shares most n-grams with the word it hides, so it
lands near it unseen. Embeddings and layer are trained together in numpy on a
bounded sample of labelled rows. As everything before the softmax is linear, a
text's logit is the mean of its words' values, so scoring needs one number for
each n-gram bucket. N-grams that lean to neither class in the sample have no
vector: with one for each, the few thousand rows are learnt by heart (README).

Each class is sampled at its own rate; the logit is then moved by the log of what
that did to the odds, so a score means the same at every size of the table.

Defined cases: null and empty texts and texts without words score as the bias of
an empty bag; without labelled rows of both classes every text scores the share
of toxic ones (0 if none); a document labelled twice is toxic if any label says
so; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_text, for_texts, span_hashes, steps, text_buffers, tidy

#: Labelled rows of each class that training may use, in expectation (picked by hash).
SAMPLE = 3000
STRETCH = 1 << 17  # code points that training takes of a row: a stretch that begins at a place given by a hash
BUCKETS, DIM, SIZES = 1 << 18, 4, (4, 5, 6, 8)
STEPS, BATCH, RATE, DECAY = 400, 256, 0.04, 1e-5  # of gradient descent
SCALE = 16.0  # of the mean vector before the layer
MIN_TEXTS, Z, PRIOR = 4, 4.5, 8  # see train(); neutral words added to each bag

_FOLD = LOWER.copy()
_FOLD[:128][~np.isin(np.arange(128), np.r_[48:58, 97:123])] = 32
_FOLD[65:91] = np.arange(97, 123)


class Bags:
    """N-gram buckets of texts by word, and words by text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        # Every text is led by a space; a word owns the bytes from the space before it to the next word's.
        x = np.full(len(data) + n + 8, 32, np.uint8)
        place = np.ones(len(data) + n, bool)
        place[at[:-1] + np.arange(n)] = False
        x[: len(data) + n][place] = _FOLD[data]
        gap = x == 32
        self.starts = begin = np.flatnonzero(gap[:-1] & ~gap[1:])  # the space before each word
        row = np.searchsorted(at[:-1] + np.arange(n), begin, "right") - 1
        self.new = np.ones(len(begin), bool)
        if len(begin):  # a word just repeated counts once
            end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
            name = span_hashes(x, begin + 1, end)
            self.new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        self.n, self.row, self.x, self.gap = n, row[self.new], x, gap

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n-gram size: the bucket at every byte, and whether an n-gram of one word starts there."""
        size = len(self.x) - 8
        eight = np.lib.stride_tricks.as_strided(self.x, (size, 8), (1, 1))
        eight = np.ascontiguousarray(eight).view("<u8").ravel()
        inner = ~self.gap
        ok = inner[1 : size + 1].copy()
        for n in range(3, max(SIZES) + 1):
            if n > 3:
                ok &= inner[n - 2 : n - 2 + size]
            if n in SIZES:
                cut = (eight & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
                cut ^= cut >> np.uint64(29)
                yield ((cut * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 18)).astype(np.int32), ok & ~(self.gap[:size] & self.gap[n - 1 : n - 1 + size])

    def logits(self, value: np.ndarray, bias: float) -> np.ndarray:
        """Of each text: the mean of its words' values, plus the bias."""
        out = np.full(self.n, bias)
        if not len(self.row):
            return out
        total, number, known = (np.zeros(len(self.x) - 8, kind) for kind in (np.float32, np.int32, np.int32))
        for bucket, ok in self.grams():
            own = np.where(ok, value[bucket], np.float32(0))
            total += own
            number += ok
            known |= own != 0
        word = np.add.reduceat(total, self.starts, dtype=np.float64)[self.new] / np.maximum(1, np.add.reduceat(number, self.starts)[self.new])
        known = np.maximum.reduceat(known, self.starts)[self.new]
        return out + np.bincount(self.row, word, self.n) / (np.bincount(self.row, known, self.n) + PRIOR)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, bucket and weight in the word's mean of all n-grams."""
        places, buckets = [], []
        for bucket, ok in self.grams():
            p = np.flatnonzero(ok)
            places.append(p)
            buckets.append(bucket[p])
        p, b = np.concatenate(places), np.concatenate(buckets).astype(np.int64)
        word = np.searchsorted(self.starts, p, "right") - 1
        kept = self.new[word] if len(word) else np.zeros(0, bool)
        b, word = b[kept], (np.cumsum(self.new) - 1)[word[kept]]
        return word, b, 1.0 / np.bincount(word, minlength=len(self.row))[word] if len(word) else np.zeros(0)


def _chunks(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, Bags]]:
    """Bags of a few texts at a time, each with its first text's place."""
    low = 0
    while low < len(texts):
        raw, size, high = [], 0, low
        while high < len(texts) and (not raw or size < most):
            raw.append(texts[high].encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            high += 1
        yield low, Bags(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        low = high


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """One value for each bucket, and the bias, from jointly trained embeddings and softmax layer."""
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), 50.0 if share else -50.0
    # Only n-grams that lean to one class get a vector: by texts of each class that have them, Z deviations or more.
    y, n = np.asarray(toxic, np.float32), len(texts)
    every, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for low, bags in _chunks(texts):
        word, bucket, _ = bags.sparse()
        text, gram = np.divmod(np.unique(bags.row[word] * BUCKETS + bucket), BUCKETS)
        every += np.bincount(gram, minlength=BUCKETS)
        bad += np.bincount(gram, y[low + text], BUCKETS)
    lean = np.abs(bad - share * every) / np.sqrt(np.maximum(share * (1 - share) * every * (1 - every / n), 1e-9))
    leaning = (lean >= Z) & (every >= MIN_TEXTS)
    parts = []
    for low, bags in _chunks(texts):
        word, bucket, weight = bags.sparse()
        kept = leaning[bucket]
        word, bucket, weight = word[kept], bucket[kept], weight[kept]
        words = np.bincount(bags.row[np.unique(word)], minlength=bags.n) + PRIOR  # the known ones of each text
        key, where = np.unique(bags.row[word] * BUCKETS + bucket, return_inverse=True)
        parts.append((key // BUCKETS + low, key % BUCKETS, (np.bincount(where, weight, len(key)) * SCALE / words[key // BUCKETS]).astype(np.float32)))
    text, bucket, weight = (np.concatenate(x) for x in zip(*parts))
    used, bucket = np.unique(bucket, return_inverse=True)
    if not len(used):
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    first = np.searchsorted(text, np.arange(n + 1))
    rng = np.random.default_rng(7)
    emb = (rng.standard_normal((len(used), DIM)) * 0.05).astype(np.float32)
    layer, bias = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    bias[1] = np.log(share / (1 - share))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, layer, bias)]
    step = 0
    epochs = -(-STEPS * BATCH // n)
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for low in range(0, n, BATCH):
            docs = order[low : low + BATCH]
            size = first[docs + 1] - first[docs]
            local = np.repeat(np.arange(len(docs)), size)
            entry = np.arange(len(local)) - np.repeat(np.cumsum(size) - size, size) + first[docs][local]
            b, w = bucket[entry], weight[entry]
            vec = np.stack([np.bincount(local, w * emb[b, k], minlength=len(docs)) for k in range(DIM)], axis=1).astype(np.float32)
            out = vec @ layer + bias
            g = ((sigmoid(out[:, 1] - out[:, 0]) - y[docs]) / len(docs)).astype(np.float32)
            both = np.stack([-g, g], axis=1)
            back = both @ layer.T
            grads = [np.stack([np.bincount(b, w * back[local, k], minlength=len(used)) for k in range(DIM)], axis=1).astype(np.float32) + DECAY * emb, vec.T @ both + DECAY * layer, both.sum(axis=0)]
            step += 1
            for x, grad, (m, v) in zip((emb, layer, bias), grads, state):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    value = np.zeros(BUCKETS, np.float32)
    value[used] = emb @ (layer[:, 1] - layer[:, 0]) * SCALE
    return value, float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most about `rows` documents of each class, by hash; their ids are a bounded broadcast. And
    by how much the log-odds of class 1 over all labels differ from those of the two sampling rates."""
    known = labels.where("doc_id is not null and toxic is not null").where(f"{crc_text('doc_id')} % 5 != 0").groupBy("doc_id").agg((F.max("toxic") != 0).cast("int").alias("toxic"))
    per = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not per:
        return [], np.zeros(0), 0.0
    rate = {k: min(1_000_000, -(-1_000_000 * rows // n)) for k, n in per.items()}
    share = F.create_map(*(F.lit(y) for k in per for y in (k, rate[k])))
    ids = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("toxic")])
    stretch = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id), greatest(1, length(text) - {STRETCH} + 1)) as int), {STRETCH})")
    got = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", stretch.alias("text"), "toxic").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in got], np.array([r["toxic"] for r in got]), float(np.log(rate.get(0, 1) / rate.get(1, 1)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    texts, toxic, shift = sample(for_texts(docs), labels)
    value, bias = train(texts, toxic)
    sent = docs.sparkSession.sparkContext.broadcast((value, bias + shift))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, b = sent.value
        for batch in steps(batches, most=2 << 20):
            data, at = text_buffers(batch.column(1))
            p = sigmoid(Bags(data, at).logits(v, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.expr(f"{crc_text('doc_id')} % 5 = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
