"""Sum-of-squares packing: ids against the tokenizer over whole texts, places against a plain version."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brindle.llm import sum_of_squares_packing as op
from brindle.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PARTS = (
    "' 's 'S s t re 're A a é É é ́ İ İ ſ K ß Σ ς     0 1 ٣ ½ <|endoftext|> < | > _ - — … 漢 字 \x1c \x1f \x00 \x7f \x85 ! !' don't ﬁ 한 ᄒ ᅡ ᆫ"
    " ̸ = ≮ 😀 ‍ ﻿ The THE word 2024 a@b.org"
).split(" ") + [" ", "  ", "\n", "\t", "\x0b"]


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(VOCABULARY)
    out.encode_special_tokens = True
    return out


def whole(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_ids_equal_the_tokenizer_over_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " ", "0", "0 0", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(4000)), "x" * 100_000, "é" * 30_000, "0" * 5000]
    monkeypatch.setattr(op, "KEPT", 300)  # some units are kept, others encoded again
    encoder = op.Encoder(VOCABULARY)
    for low in range(0, len(texts), 700):
        some = texts[low : low + 700]
        ids, ends = encoder.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole(tokenizer, t).tolist() for t in some]
    assert len(encoder.known) == 300


def plain_bins(lengths, most):
    """One piece after another, largest first, each where the sum of squares over all gaps is smallest."""
    bins, out = [], []
    for s in sorted(lengths, reverse=True):
        counts = collections.Counter(g for g in bins if g)
        best = None
        for g in sorted(counts):
            if g >= s:
                then = counts.copy()
                then[g] -= 1
                if g > s:
                    then[g - s] += 1
                total = sum(n * n for n in then.values())
                if best is None or total < best[0]:
                    best = total, g
        if best is None:
            bins.append(most - s)
        else:
            bins[bins.index(best[1])] -= s
        out.append(s)
    return sorted(bins)


def seats(rows, counts):
    """(bin, offset, length) of every piece by the plan."""
    lengths, firsts, bins, offsets = (x.tolist() for x in rows)
    out = []
    for i, s in enumerate(lengths):
        upto = firsts[i + 1] if i + 1 < len(lengths) and lengths[i + 1] == s else counts[s]
        out += [(bins[i] + k, offsets[i], s) for k in range(upto - firsts[i])]
    return out


def assert_gapless(placed, most):
    by_bin = collections.defaultdict(list)
    for b, offset, length in placed:
        by_bin[b].append((offset, length))
    for found in by_bin.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= most
    return by_bin


def test_one_by_one_equals_a_plain_version():
    rng = random.Random(2)
    for most, n in ((12, 60), (40, 150), (100, 90), (5, 1), (7, 0)):
        lengths = [rng.randrange(1, most + 1) for _ in range(n)]
        counts = dict(collections.Counter(lengths))
        placed = seats(op.plan(counts, most, 10**9), counts)
        by_bin = assert_gapless(placed, most)
        assert sorted(s for *_, s in placed) == sorted(lengths)
        assert sorted(most - sum(s for _, s in x) for x in by_bin.values()) == plain_bins(lengths, most)


@pytest.mark.parametrize("lots", [8, 64, 256])
def test_lots_of_many_pieces(lots):
    """The plan doesn't grow with the number of pieces, and its bins stay near the least number."""
    rng = random.Random(4)
    shape = {s: rng.randrange(1, 50) for s in rng.sample(range(1, 400), 200)} | {9: 4000, 400: 900}
    sizes = []
    for times in (1, 1000):
        counts = {s: n * times for s, n in shape.items()}
        rows = op.plan(counts, 400, lots)
        sizes.append(len(rows[0]))
        if times == 1:
            assert_gapless(seats(rows, counts), 400)
        last = max(int(b) + n for b, n in zip(rows[2], lengths_of(rows, counts)))
        least = -(-sum(s * n for s, n in counts.items()) // 400)
        assert last <= {8: 1.15, 64: 1.03, 256: 1.01}[lots] * least  # few short pieces and many of two lengths: a hard case
    assert sizes[1] <= 2 * 200 * lots


def lengths_of(rows, counts):
    lengths, firsts = rows[0].tolist(), rows[1].tolist()
    return [(firsts[i + 1] if i + 1 < len(lengths) and lengths[i + 1] == s else counts[s]) - firsts[i] for i, s in enumerate(lengths)]


@pytest.mark.parametrize("most", [4096, 7])
def test_odd_rows_are_packed_whole(spark, tokenizer, most):
    rng = random.Random(most)
    texts = [None, "", "one two three " * 3000, "x", *(" ".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(150))]
    rows = [*enumerate(texts), (None, "null id"), (None, None), (3, "x"), (3, "y"), *((500 + i, "copied text") for i in range(80))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int").repartition(4)
    got = op.packed(docs, VOCABULARY, most).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = whole(tokenizer, t)
        for p in range(0, len(ids), most):
            want[i, p // most, p, len(ids[p : p + most]), zlib.crc32(ids[p : p + most].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_bin = assert_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], most)
    least = -(-sum(r["length"] for r in got) // most)
    assert len(by_bin) <= least + (1 if most > 100 else 0.05 * least)


def test_empty_table(spark):
    assert op.packed(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_texts_are_not_shuffled(spark, data):
    plan = op.pieces(table(spark, data, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
