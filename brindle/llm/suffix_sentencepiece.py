"""SentencePiece BPE encoding and decoding by suffix-array matching.

A step of texts is reduced to its distinct units (a run of spaces with the
characters up to the next space; no piece reaches over a unit's start). Their
concatenation is indexed by a suffix array; every piece of the vocabulary is
binary-searched in it, and the occurrences found are the edges of a lattice. The
edges are sorted by position and relaxed from left to right: at each place the
one piece survives that the encoding of the text so far ends with. A piece may
follow another only if byte-pair merging of the two together leaves both whole;
with that rule the chain is the one that merging by score gives, so the ids equal
the tokenizer's. Characters that are no piece become byte pieces.

Units up to LONG_UNIT bytes are relaxed together, one place of all of them at a
time. A longer one is relaxed alone, its edges found and walked a SEGMENT at a
time, so it costs time in proportion to its length, and memory beyond a segment's
only for its bytes and one number each.

The vocabulary is read from the model file on the driver (its path is a parameter,
or the setting spark.brindle.tokenizer) and sent to executors; nothing is trained.

Defined cases: null texts count as empty; empty texts have no ids; the mark
U+2581 in a text encodes as a space, as the tokenizer has it, and so doesn't come
back; all other texts round-trip exactly, of whatever length, and without a space
in them; repeated rows encode alike; extra columns are ignored by `encode`, and
passed through by `encode_columns`, which puts its own `ids`, `n_tokens` and
`round_trip` in the place of columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_texts, steps, text_buffers, tidy, word_codes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # where neither a parameter nor the setting names one
SPACE_MARK = "▁".encode()
FAR = 1 << 30
#: Text bytes of a step: its lattice takes about a hundred times as much for a moment.
STEP = 1 << 20
LONG_UNIT, SEGMENT = 1 << 11, 1 << 19


class Vocabulary:
    """Pieces by id as bytes (space mark as a space), with merge ranks."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        """pieces: (id, text, score) of the ordinary pieces."""
        self.size, self.byte_ids = size, np.array(byte_ids, np.int32)
        self.text = {i: p.replace("▁", " ") for i, p, _ in pieces}
        order = sorted(pieces, key=lambda x: (-x[2], x[0]))
        self.rank = {p.replace("▁", " "): r for r, (_, p, _) in enumerate(order)}
        self.raw: list[bytes] = [b""] * size
        for i, p in self.text.items():
            self.raw[i] = p.encode()
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        single = {p for p in self.rank if len(p) == 1}
        if {c for p in self.rank for c in p} - single or any(" " in p.lstrip(" ") for p in self.rank):
            raise ValueError("not a vocabulary of units: a piece has a character that is no piece, or a space inside")
        self.compatible: dict[int, bool] = {}
        whole = [i for i, p in self.text.items() if self.merged(p) == [p]]
        self.ids = np.array(sorted(whole, key=lambda i: self.raw[i]), np.int32)
        self.depth = max(len(self.raw[i]) for i in whole)
        if self.depth > 255:
            raise ValueError("pieces of at most 255 bytes")
        self.width = np.array([len(r) for r in self.raw], np.int64)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        # Search keys: eight bytes each, padded with the lowest and the highest byte.
        keys = -(-self.depth // 8)
        flat = np.zeros((len(self.ids), 8 * keys), np.uint8)
        for k, i in enumerate(self.ids):
            flat[k, : len(self.raw[i])] = np.frombuffer(self.raw[i], np.uint8)
        self.low = flat.view(">u8").astype(np.uint64)
        pad = np.arange(8 * keys)[None, :] >= self.width[self.ids][:, None]
        self.high = np.where(pad, np.uint8(255), flat).view(">u8").astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.width)])
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    @staticmethod
    def load(path: str) -> tuple:
        """Constructor arguments from a model file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return [(i, sp.id_to_piece(i), sp.get_score(i)) for i in plain], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n

    def merged(self, text: str) -> list[str]:
        """Merging by score, plainly: the best adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = FAR, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1], FAR)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may stand right after each `before` (-1: a unit's start); byte pieces stand anywhere."""
        out = (before < 0) | self.is_byte[np.maximum(before, 0)]
        ask = np.flatnonzero(~out)
        if len(ask):
            pairs, where = np.unique(before[ask] * self.size + piece[ask], return_inverse=True)
            known = self.compatible
            answer = np.empty(len(pairs), bool)
            for k, key in enumerate(pairs.tolist()):
                got = known.get(key)
                if got is None:
                    a, b = self.text[key // self.size], self.text[key % self.size]
                    got = known[key] = self.merged(a + b) == [a, b]
                answer[k] = got
            out[ask] = answer[where]
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        return out

    def may_follow(self, before: int, piece: int) -> bool:
        """The same for one piece."""
        if before < 0 or self.is_byte[before]:
            return True
        key = before * self.size + piece
        got = self.compatible.get(key)
        if got is None:
            a, b = self.text[before], self.text[piece]
            got = self.compatible[key] = self.merged(a + b) == [a, b]
        return got


def _bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted in a range of its own for each target."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        less = keys[mid] <= target[open_] if right else keys[mid] < target[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]


def suffix_array(data: np.ndarray, ends: np.ndarray, places: np.ndarray, keys: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """places sorted by the first 8*keys bytes from each (nothing after its unit's end counts), and the sorted keys."""
    padded = np.concatenate([data, np.zeros(8 * keys + 8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 8 * keys, 8), (1, 1))
    left = ends - places
    columns = []
    for k in range(keys):
        word = np.ascontiguousarray(eight[places + 8 * k]).view(">u8").ravel().astype(np.uint64)
        rest = np.clip(left - 8 * k, 0, 8)
        columns.append(word & _KEEP[rest])
    order = np.argsort(columns[0], kind="stable")
    first = columns[0][order]
    same = np.append(False, first[1:] == first[:-1])
    tied = same.copy()
    tied[:-1] |= same[1:]
    at = np.flatnonzero(tied)
    if len(at):  # only ties look further
        again = np.lexsort([*(c[order[at]] for c in columns[:0:-1]), np.cumsum(~same)[at]])
        order[at] = order[at][again]
    return places[order], [c[order] for c in columns]


_KEEP = np.array([((1 << 64) - 1) ^ ((1 << 8 * (8 - n)) - 1) for n in range(9)], np.uint64)


def edges(data: np.ndarray, ends: np.ndarray, places: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces inside units: start and piece id."""
    array, columns = suffix_array(data, ends, places, v.low.shape[1])
    lo = np.searchsorted(columns[0], v.low[:, 0], "left")
    hi = np.searchsorted(columns[0], v.high[:, 0], "right")
    for k in range(1, len(columns)):
        deep = np.flatnonzero((v.width[v.ids] > 8 * k) & (lo < hi))
        a = _bisect(columns[k], lo[deep], hi[deep], v.low[deep, k], False)
        b = _bisect(columns[k], lo[deep], hi[deep], v.high[deep, k], True)
        lo[deep], hi[deep] = a, b
    count = np.maximum(hi - lo, 0)
    first = np.repeat(lo - (np.cumsum(count) - count), count)
    return array[first + np.arange(int(count.sum()))], np.repeat(v.ids, count)


def encode_units(data: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units data[at[i]:at[i+1]] laid end to end, and their number for each unit."""
    size = np.diff(at)
    long = np.flatnonzero(size > LONG_UNIT)
    if not len(long):
        return encode_short(data, at, v)
    short = np.flatnonzero(size <= LONG_UNIT)
    alone = [encode_long(data[at[i] : at[i + 1]], v) for i in long]
    ids, count = encode_short(data[np.repeat(size <= LONG_UNIT, size)], np.concatenate([[0], np.cumsum(size[short])]), v)
    counts = np.empty(len(size), np.int64)
    counts[short], counts[long] = count, [len(x) for x in alone]
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[gather(first[short], count)] = ids
    for i, x in zip(long, alone):
        out[first[i] : first[i] + len(x)] = x
    return out, counts


def encode_long(data: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids of one unit, segment by segment."""
    size = len(data)
    last = np.full(size + 1, -2, np.int32)  # as in encode_short
    last[0] = -1
    for low in range(0, size, SEGMENT):
        part = data[low : low + SEGMENT + v.depth]  # pieces that start in the segment end in here
        lead = (part & 0xC0) != 0x80
        lead[0] |= low == 0
        places = np.flatnonzero(lead)
        width = np.diff(np.append(places, len(part)))
        inside = places < SEGMENT
        start, piece = edges(part, np.full(int(inside.sum()), len(part)), places[inside], v)
        end = start + v.width[piece]
        whole = np.zeros(len(part), np.int64)
        whole[places] = width
        known = np.zeros(len(part), bool)
        known[start[end - start == whole[start]]] = True
        odd = inside & ~known[places]
        p = gather(places[odd], width[odd])
        last[low + p + 1] = v.byte_ids[part[p]]
        order = np.lexsort((start, end))  # the longest first
        start, end, piece = start[order] + low, end[order] + low, piece[order]
        for cut in range(0, len(order), 1 << 16):
            own = slice(cut, cut + (1 << 16))
            base = int(start[own].min())
            seen = last[base : int(end[own].max()) + 1].tolist()
            for s, e, x in zip((start[own] - base).tolist(), (end[own] - base).tolist(), piece[own].tolist()):
                if seen[e] == -2 and seen[s] != -2 and v.may_follow(seen[s], x):
                    seen[e] = x
            last[base : base + len(seen)] = seen
    ids, at = [], size
    while at:
        t = int(last[at])
        if t < 0:
            raise AssertionError("a unit has no encoding")
        ids.append(t)
        at -= int(v.width[t])
    return np.array(ids[::-1], np.int32)


def encode_short(data: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units as in `encode_units`, all relaxed together."""
    n, size = len(at) - 1, len(data)
    unit = np.repeat(np.arange(n), np.diff(at))
    lead = (data & 0xC0) != 0x80
    lead[at[:-1][np.diff(at) > 0]] = True
    places = np.flatnonzero(lead)
    start, piece = edges(data, at[1:][unit[places]], places, v)
    width = v.width[piece]
    # last[p]: the piece that the encoding of the unit up to p ends with; -1 at a unit's start.
    last = np.full(size + n + 1, -2, np.int64)
    slot = lambda p, u: p + u  # noqa: E731  a slot of its own for each unit's end
    last[at[:-1] + np.arange(n)] = -1
    # Characters without a piece: byte pieces, one step a byte.
    nexts = np.append(places[1:], size)
    known = np.zeros(size, bool)
    sizes = np.minimum(nexts, at[1:][unit[places]]) - places
    length = np.zeros(size, np.int64)
    length[places] = sizes
    known[start[width == length[start]]] = True
    odd = places[~known[places]]
    if len(odd):
        m = length[odd]
        p = np.repeat(odd - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        last[slot(p + 1, unit[p])] = v.byte_ids[data[p]]
    # Edges by the place of their end in the unit, then by end, then longest first. One key holds all three.
    end = start + width
    level = end - at[:-1][unit[start]]
    if size < 1 << 27 and int(level.max(initial=0)) < 1 << 28:
        key = level << 35 | end << 8 | (255 - width)
        order = np.argsort(key)
        key, piece = key[order], piece[order]
        level, end, start = key >> 35, (key >> 8) & ((1 << 27) - 1), ((key >> 8) & ((1 << 27) - 1)) - 255 + (key & 255)
        del key, order, width
    else:
        order = np.lexsort((-width, end, level))
        start, piece, end, level = start[order], piece[order], end[order], level[order]
    own = unit[start] if len(start) else start
    start, end = slot(start, own), slot(end, own)
    cuts = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else np.zeros(1, np.int64)
    del own, level
    for a, b in zip(cuts[:-1], cuts[1:]):
        before = last[start[a:b]]
        live = np.flatnonzero((before > -2) & (last[end[a:b]] == -2))  # from places that are reached to such that are not yet
        e, p, f = end[a:b][live], piece[a:b][live].astype(np.int64), before[live]
        while len(e):  # the longest of each end that is left
            first = np.append(True, e[1:] != e[:-1])
            ok = v.follows(f[first], p[first])
            last[e[first][ok]] = p[first][ok]
            rest = ~first & (last[e] == -2)
            e, p, f = e[rest], p[rest], f[rest]
    # Back from each unit's end.
    ids, whose = [], []
    where, live = at[1:] + np.arange(n), np.arange(n)
    live = live[np.diff(at) > 0]
    where = where[live]
    while len(live):
        t = last[where]
        if (t < 0).any():
            raise AssertionError("a unit has no encoding")
        ids.append(t)
        whose.append(live)
        where = where - v.width[t]
        more = where > at[live] + live
        live, where = live[more], where[more]
    if not ids:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    t, u = np.concatenate(ids)[::-1], np.concatenate(whose)[::-1]
    order = np.argsort(u, kind="stable")
    return t[order].astype(np.int32), np.bincount(u, minlength=n)


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + counts[i] - 1, laid end to end."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def encode_texts(text: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and n+1 offsets."""
    data, at = text_buffers(text)
    n = len(at) - 1
    if SPACE_MARK in data.tobytes():
        plain = [(x or "").replace("▁", " ").encode() for x in text.to_pylist()]
        data = np.frombuffer(b"".join(plain), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
    # A space stands before each text that isn't empty.
    some = np.diff(at) > 0
    shift = np.concatenate([[0], np.cumsum(some)])
    x = np.full(len(data) + int(shift[-1]), 32, np.uint8)
    new = at + shift
    body = np.ones(len(x), bool)
    body[new[:-1][some]] = False
    x[body] = data
    begin = x == 32
    begin[1:] &= x[:-1] != 32
    begin[new[:-1][some]] = True
    s = np.flatnonzero(begin)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    code, kinds = word_codes(x, s, np.append(s[1:], len(x)))
    unit_data, unit_at = text_buffers(kinds)
    ids, count = encode_units(unit_data, unit_at, v)
    first = np.cumsum(count) - count
    whole = ids[gather(first[code], count[code])]
    per = np.concatenate([[0], np.cumsum(count[code])])
    return whole, per[np.searchsorted(s, new)]


def decode_ids(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of id sequences laid end to end; bytes that are no UTF-8 become U+FFFD."""
    count = v.width[ids]
    raw = v.flat[gather(v.starts[ids], count)]
    ends = np.concatenate([[0], np.cumsum(count)])[at]
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        one = raw[a:b].tobytes()
        out.append((one[1:] if one[:1] == b" " else one).decode("utf-8", "replace"))
    return out


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(sent) -> Vocabulary:
    """The broadcast vocabulary, built once in each Python worker."""
    key = hash(tuple(p for _, p, _ in sent.value[0]))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(*sent.value)
    return _LOADED[key]


def _sent(spark, model: str | None):
    """The vocabulary of a model file as a broadcast of its size."""
    return spark.sparkContext.broadcast(Vocabulary.load(model or spark.conf.get("spark.brindle.tokenizer", MODEL)))


def encode_columns(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with `ids` (array of int), `n_tokens` and `round_trip` (whether decoding gives the text back)."""
    sent = _sent(docs.sparkSession, model)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    docs = for_texts(docs).drop(*(f.name for f in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent)
        for batch in steps(batches, most=STEP):
            text = batch.column(batch.schema.get_field_index("text"))
            ids, at = encode_texts(text, v)
            same = [a == (b or "") for a, b in zip(decode_ids(ids, at, v), text.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)), pa.array(same, pa.bool_())],
                names=[*batch.schema.names, *(f.name for f in added)],
            )

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip for every row."""
    return encode_columns(docs.select("doc_id", "text"), model).select("doc_id", "n_tokens", "ids", "round_trip")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; null ids count as none."""
    sent = _sent(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            ids = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode_ids(ids, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), v), pa.string())], names=["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids")).mapInArrow(tidy(run), f"doc_id {id_type}, text string")
