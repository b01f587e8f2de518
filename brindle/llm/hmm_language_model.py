"""A hidden Markov language model over words.

Tokens are whitespace-separated words and one end for each text. Exact counts of
all training tokens are made with a shuffle. The TOP most frequent words and the
end are symbols of their own; every other word belongs to a class given by its
last bytes, and a class spreads its probability over its words by their counts,
with one share for unseen words. The model emits symbols from STATES latent
states: Baum-Welch runs over all training texts, each of them whole; partitions
add up expected counts, and the counts meet in a sum by symbol. A text's score is
the exact log10 likelihood by the scaled forward recursion over its whole length.

A text of any length is handled in bounded memory: what is longer than a window
is cut, the windows' transfer matrices are chained forwards and backwards, and so
every window starts and ends with the exact vectors of the whole text.

Texts are read once, in blocks of rows: a block's distinct words are counted and
looked up together, so the shuffle carries words of blocks and not of texts. Only
tables of fixed size (symbols by states, classes) reach the driver.

Words are told apart by a 64-bit hash: with V distinct words the chance of any
collision is V^2 / 2^65 (below 1e-5 for ten million words).

Defined cases: a null text is empty and has just its end; without training rows
all counts are 0 and every token's base probability is 1; repeated rows count
each; a null doc_id hashes as an empty text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UNSPACED, crc_text, discard, for_texts, span_hashes, steps, text_buffers, tidy, word_spans, written

BLOCK_BYTES = 12 << 20
PIECE_BYTES = 1 << 20  # of a block whose words are told apart at a time
TOP, CLASSES, STATES = 2000, 512, 8
ROUNDS = 6  # of Baum-Welch, each over all training texts
WINDOW = 1 << 11  # longer texts are cut to windows of this many tokens, which transfer matrices join exactly
SLICE = 1 << 17  # tokens of windows that a recursion holds at a time
MIX = 1e-4  # share of an even spread in each state's moves: keeps short products of them from vanishing
SCALED, LEAST = 6, 1e-30  # tokens between two scalings; a token's unscaled mass below which a block is done again in doubles
SYMBOLS = TOP + CLASSES + 1
END = SYMBOLS - 1
_CODEC = {"level": 1}


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(**_CODEC).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def suffix_class(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The class of each word: a hash of its last three bytes."""
    low = np.maximum(s, e - 3)
    return (span_hashes(data, low, e) % np.uint64(CLASSES)).astype(np.int32)


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """Blocks of rows as code sequences (kind 0) and the blocks' words with training counts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, pieces, size = TaskContext.get().partitionId(), 0, [], 0
        for piece in steps(batches, most=PIECE_BYTES):
            pieces.append(told_apart(piece))
            size += pieces[-1][-1]
            if size >= BLOCK_BYTES:
                yield from joined(pieces, (part << 32) | number)
                number, pieces, size = number + 1, [], 0
        if pieces:
            yield from joined(pieces, (part << 32) | number)

    def told_apart(piece: pa.RecordBatch) -> tuple:
        """Ids, held and number of words of the rows; hash, class, count and count in training rows of each distinct
        word; the word's number at each place; and the bytes of text."""
        ids, text, held = (piece.column(piece.schema.get_field_index(c)) for c in ("doc_id", "text", "held"))
        data, at = text_buffers(text)
        data, held = LOWER[data], held.to_numpy(zero_copy_only=False)
        s, e, row = word_spans(data, at, UNSPACED)
        word, first, code = np.unique(span_hashes(data, s, e), return_index=True, return_inverse=True)
        count = lambda x, n: np.bincount(x, minlength=n) if len(x) else np.zeros(n, np.int64)
        return ids, held, count(row, len(held)).astype(np.int32), word, suffix_class(data, s[first], e[first]), count(code, len(word)), count(code[~held[row]], len(word)), code.astype(np.int32), len(data)

    def joined(pieces: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
        """The rows of a block: its sequences, and its distinct words, the frequent ones first, which pack well."""
        ids, held, counts, word, kind, seen, learnt, codes, _ = zip(*pieces)
        ids, (held, counts, words, kind, seen, learnt) = pa.concat_arrays(ids), (np.concatenate(x) for x in (held, counts, word, kind, seen, learnt))
        word, first, to = np.unique(words, return_index=True, return_inverse=True)
        total = lambda x: np.bincount(to, x, len(word)).astype(np.int64)
        order = np.argsort(-total(seen), kind="stable")
        place = np.empty(len(word), np.int32)
        place[order] = np.arange(len(word), dtype=np.int32)
        to_, lows = place[to], np.cumsum([0, *(len(x[3]) for x in pieces)])
        code = np.concatenate([to_[low + x] for low, x in zip(lows, codes)]).astype(np.int32)
        word, kind, learnt = word[order].view(np.int64), kind[first][order], total(learnt)[order]
        yield pa.RecordBatch.from_arrays([
            pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            *(pa.array([_pack(x)], pa.binary()) for x in (held, counts, code)), *(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())),
        ], names=NAMES)
        for low in range(0, len(word), 1 << 14):
            own = slice(low, low + (1 << 14))
            m = len(word[own])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(m, np.int32)), pa.array(np.full(m, block)), pa.nulls(m, pa.list_(ids.type)), *(pa.nulls(m, pa.binary()) for _ in range(3)),
                pa.array(word[own]), pa.array(np.arange(low, low + m, dtype=np.int32)), pa.array(kind[own]), pa.array(learnt[own]),
            ], names=NAMES)

    NAMES = ["kind", "block", "ids", "held", "counts", "codes", "word", "code", "class", "learnt"]
    schema = f"kind int, block long, ids array<{id_type}>, held binary, counts binary, codes binary, word long, code int, class int, learnt long"
    return docs.mapInArrow(tidy(run), schema)


class Lexicon:
    """Bounded tables: totals, and words and tokens of each class beyond the TOP words."""

    def __init__(self, tokens: int, kinds: int, ends: int, class_tokens: np.ndarray, class_kinds: np.ndarray, top: np.ndarray):
        self.tokens, self.kinds, self.ends = tokens, kinds, ends
        self.class_log = np.log10(class_tokens + class_kinds + 1)
        # Symbol counts, each at least a little above 0, to smooth and start from.
        self.unigram = np.concatenate([top, np.zeros(TOP - len(top)), class_tokens + 1, [ends + 1]]).astype(float)
        self.unigram[: len(top)] += 0.5
        self.unigram /= self.unigram.sum()


def _encode(blocks: DataFrame, answers: DataFrame, sent, id_type: str) -> DataFrame:
    """Blocks as symbol sequences, with what doesn't need the states: counts of tokens, base and class scores."""
    names = ["ids", "held", "counts", "symbols", "known", "base", "lexical"]

    def run(key, block: pa.Table, words: pa.Table) -> pa.Table:
        lex: Lexicon = sent.value
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in (block.schema.field("ids").type, *[pa.binary()] * 6)], names=names)
        counts = _unpack(block.column("counts")[0].as_py(), np.int32).astype(np.int64)
        code = _unpack(block.column("codes")[0].as_py(), np.int32)
        n = words.num_rows
        at = words.column("code").to_numpy()
        c, symbol, kind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        c[at], symbol[at], kind[at] = words.column("c").to_numpy(), words.column("symbol").to_numpy(), words.column("class").to_numpy()
        rare = symbol < 0
        symbol = np.where(rare, TOP + kind, symbol)
        total = np.log10(lex.tokens + lex.kinds + 1)
        base = np.log10(c + 1) - total
        lexical = np.where(rare, np.log10(c + 1) - lex.class_log[kind], 0.0)
        ends = np.cumsum(counts)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[code])])[np.concatenate([[0], ends])])
        seq = np.insert(symbol[code], ends, END).astype(np.int16)
        return pa.table([
            block.column("ids"), block.column("held"), pa.array([_pack(counts + 1)], pa.binary()), pa.array([_pack(seq)], pa.binary()),
            pa.array([_pack(sums(c > 0) + (lex.ends > 0))], pa.binary()), pa.array([_pack(sums(base) + np.log10(lex.ends + 1) - total)], pa.binary()), pa.array([_pack(sums(lexical))], pa.binary()),
        ], names=names)

    schema = f"ids array<{id_type}>, held binary, counts binary, symbols binary, known binary, base binary, lexical binary"
    return blocks.groupBy("block").cogroup(answers.groupBy("own")).applyInArrow(run, schema)


class States:
    """Parameters of the latent states; emit is by symbol, then state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(unigram: np.ndarray) -> States:
        rng = np.random.default_rng(11)
        emit = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return States(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @staticmethod
    def again(counts: np.ndarray, unigram: np.ndarray) -> States:
        """From expected counts: rows of symbols, then of states left, then of starts."""
        emit, move = counts[:SYMBOLS] + 5.0 * unigram[:, None] * len(unigram) / 100, counts[SYMBOLS : SYMBOLS + STATES] + 0.1
        start, move = counts[SYMBOLS + STATES] + 0.1, move / move.sum(axis=1, keepdims=True)
        return States(start / start.sum(), (1 - MIX) * move + MIX / STATES, emit / emit.sum(axis=0))


class Windows:
    """Texts laid end to end as windows of at most WINDOW tokens, in slices of the longest first. All arrays are by
    state, then by window; a slice's tokens are ordered by their place in the window, so each step reads a run of them."""

    def __init__(self, seq: np.ndarray, counts: np.ndarray, p: States, kind: type = np.float32):
        self.seq, self.p, self.kind = seq, p, kind
        self.move, self.turned = p.move.astype(kind), np.ascontiguousarray(p.move.T).astype(kind)
        self.top = p.emit.max(axis=1)
        self.emit = np.ascontiguousarray((p.emit / self.top[:, None]).T).astype(kind)  # each symbol's highest is 1
        per = -(-counts // WINDOW)
        self.text = np.repeat(np.arange(len(counts)), per)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)
        self.low = (np.cumsum(counts) - counts)[self.text] + self.number * WINDOW
        self.size = np.minimum(WINDOW, counts[self.text] - self.number * WINDOW)
        self.last = np.append(self.number[1:] == 0, True) if len(self.text) else np.zeros(0, bool)

    def slices(self, pick: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The windows picked, in slices of at most `most` tokens or one window, and where each step's tokens begin."""
        order = pick[np.argsort(-self.size[pick], kind="stable")]
        at = 0
        while at < len(order):
            own = order[at : at + max(1, int(np.searchsorted(np.cumsum(self.size[order[at : at + most]]), most, "right")))]
            at += len(own)
            size = self.size[own]
            live = len(own) - np.searchsorted(size[::-1], np.arange(int(size[0])), "right")  # windows longer than t
            yield own, np.concatenate([[0], np.cumsum(live)])

    def tokens(self, own: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The symbols of a slice, step by step."""
        live = np.diff(begin)
        step = np.repeat(np.arange(len(live)), live)
        return self.seq[self.low[own][np.arange(int(begin[-1])) - begin[step]] + step]

    def transfer(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window picked, and each state before it, the states after it as a vector of sum 1 and the log of its scale
        (without that of the symbols)."""
        out, logs = np.empty((len(pick), STATES, STATES), self.kind), np.zeros((len(pick), STATES))
        at = np.full(len(self.size), -1)
        at[pick] = np.arange(len(pick))
        for own, begin in self.slices(pick, SLICE):
            e = self.emit.take(self.tokens(own, begin), axis=1)
            x = np.repeat(np.eye(STATES, dtype=self.kind)[:, None, :], len(own), axis=1)  # state after, window, state before
            log = np.zeros((len(own), STATES))
            for t in range(len(begin) - 1):
                n = int(begin[t + 1] - begin[t])
                y = (self.turned @ x[:, :n].reshape(STATES, -1)).reshape(STATES, n, STATES)
                y *= e[:, begin[t] : begin[t + 1], None]
                if t % SCALED == SCALED - 1:
                    scale = y.sum(axis=0)
                    y /= scale
                    log[:n] += np.log(scale)
                x[:, :n] = y
            scale = x.sum(axis=0)
            out[at[own]] = (x / scale).transpose(1, 2, 0)
            logs[at[own]] = log + np.log(scale)
        return out, logs

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the exact forward vector before its first token (moved already) and backward vector at its last."""
        n = len(self.size)
        ahead, back = np.empty((STATES, n)), np.ones((STATES, n))
        ahead[:, self.number == 0] = self.p.start[:, None]
        later = np.flatnonzero(self.number > 0)
        if len(later):
            matrix, log = self.transfer(later)
            weight = np.exp(log - log.max(axis=1, keepdims=True))[:, :, None] * matrix
            at = np.full(n, -1)
            at[later] = np.arange(len(later))
            a = np.ones((STATES, n))  # forward vectors after each window
            heads = np.flatnonzero((self.number == 0) & ~self.last)
            a[:, heads] = self.after(heads)
            for k in range(1, int(self.number.max()) + 1):
                now = np.flatnonzero(self.number == k)
                ahead[:, now] = (a[:, now - 1].T @ self.p.move).T
                x = np.einsum("in,nij->jn", a[:, now - 1], weight[at[now]])
                a[:, now] = x / x.sum(axis=0)
            for k in range(int(self.number.max()), 0, -1):
                now = np.flatnonzero(self.number == k)
                x = np.einsum("nij,jn->in", weight[at[now]], back[:, now])
                back[:, now - 1] = x / x.sum(axis=0)
            self.before = a
        return ahead, back

    def after(self, pick: np.ndarray) -> np.ndarray:
        """Forward vectors after the windows picked, which begin their texts."""
        out = np.empty((STATES, len(self.size)))
        for own, begin in self.slices(pick, SLICE):
            f, _ = self.forward(begin, self.emit.take(self.tokens(own, begin), axis=1), self.p.start[:, None].repeat(len(own), 1))
            out[:, own] = f[:, begin[self.size[own] - 1] + np.arange(len(own))]
        return out[:, pick] / out[:, pick].sum(axis=0)

    def forward(self, begin: np.ndarray, e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward vectors at all tokens of a slice from vectors a before the first, and what each was divided by."""
        f, by = np.empty_like(e), np.ones(e.shape[1], self.kind)
        np.multiply(a.astype(self.kind), e[:, : begin[1]], out=f[:, : begin[1]])
        for t in range(1, len(begin) - 1):
            low, high = begin[t], begin[t + 1]
            x = self.turned @ f[:, begin[t - 1] : begin[t - 1] + high - low]
            if t % SCALED:
                np.multiply(x, e[:, low:high], out=f[:, low:high])
            else:
                x *= e[:, low:high]
                by[low:high] = x.sum(axis=0)
                np.divide(x, by[low:high], out=f[:, low:high])
        return f, by

    def backward(self, own: np.ndarray, begin: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Backward vectors at all tokens of a slice, scaled now and then, from vectors b at the last."""
        out = np.empty_like(e)
        size, b = self.size[own], b.astype(self.kind)
        ends = begin[size - 1] + np.arange(len(own))
        out[:, ends] = b
        for t in range(len(begin) - 3, -1, -1):
            low, high = begin[t + 1], begin[t + 2]
            n = high - low
            x = np.matmul(self.move, e[:, low:high] * out[:, low:high], out=out[:, begin[t] : begin[t] + n])
            if t % SCALED == 0:
                x /= x.sum(axis=0)
        return out


def expected(seq: np.ndarray, counts: np.ndarray, p: States, kind: type = np.float32) -> np.ndarray:
    """Expected counts (as in `States.again`) over texts laid end to end, by forward-backward over whole texts."""
    total = np.zeros((SYMBOLS + STATES + 1, STATES))
    if not len(seq):
        return total
    w = Windows(seq, counts, p, kind)
    ahead, back = w.edges()
    for own, begin in w.slices(np.arange(len(w.size)), SLICE):
        symbols, n = w.tokens(own, begin), len(own)
        e = w.emit.take(symbols, axis=1)
        (f, by), b = w.forward(begin, e, ahead[:, own]), w.backward(own, begin, e, back[:, own])
        e *= b  # what comes with each token, seen from the states before it
        b *= f
        mass = b.sum(axis=0)
        if kind is np.float32 and not mass.min() > LEAST:  # a text that contradicts the states at every step
            return expected(seq, counts, p, np.float64)
        b /= mass
        for j in range(STATES):
            total[:SYMBOLS, j] += np.bincount(symbols, b[j], SYMBOLS)
        starts = w.number[own] == 0
        total[SYMBOLS + STATES] += b[:, :n][:, starts].sum(axis=1)
        # Moves: each token after a window's first, with the one before it; each window's first, with the window before. A
        # token's moves add up to one: their mass is that of its states, but for what its forward vector was divided by.
        mass *= by
        e /= mass
        live = np.diff(begin)
        before = np.arange(n, len(symbols)) - np.repeat(live[:-1], live[1:])
        total[SYMBOLS : SYMBOLS + STATES] += w.move * (f.take(before, axis=1) @ e[:, n:].T)
        cut = np.flatnonzero(~starts)
        if len(cut):
            total[SYMBOLS : SYMBOLS + STATES] += w.move * (w.before[:, own[cut] - 1].astype(w.kind) @ e[:, cut].T)
    return total


def likelihood(seq: np.ndarray, counts: np.ndarray, p: States) -> np.ndarray:
    """log10 of the exact likelihood of each of the texts laid end to end in seq."""
    out = np.zeros(len(counts))
    w = Windows(seq, counts, p, np.float64)
    ahead, _ = w.edges()
    for own, begin in w.slices(np.arange(len(w.size)), SLICE):
        symbols = w.tokens(own, begin)
        a, log = ahead[:, own], np.zeros(len(own))
        e = w.emit.take(symbols, axis=1)
        for t in range(len(begin) - 1):
            low, high = begin[t], begin[t + 1]
            a = a[:, : high - low] if t == 0 else w.turned @ a[:, : high - low]
            a *= e[:, low:high]
            scale = a.sum(axis=0)
            a /= scale
            e[0, low:high] = scale
        step = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        log = np.bincount(np.arange(len(symbols)) - begin[step], np.log(e[0]) + np.log(w.top[symbols]), len(own))
        np.add.at(out, w.text[own], log)
    return out / np.log(10)


def _learn(encoded: DataFrame, unigram: np.ndarray) -> States:
    spark = encoded.sparkSession
    p = States.first(unigram)
    columns = [f"s{j}" for j in range(STATES)]
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(p)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((SYMBOLS + STATES + 1, STATES))
            for batch in batches:
                for held, counts, symbols in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    counts, seq = _unpack(counts, np.int64), _unpack(symbols, np.int16)
                    learn = ~_unpack(held, bool)
                    own = np.repeat(learn, counts)
                    total += expected(seq[own], counts[learn], sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(total[:, j]) for j in range(STATES))], names=["cell", *columns])

        parts = encoded.select("held", "counts", "symbols").mapInArrow(tidy(count), "cell int, " + ", ".join(f"{c} double" for c in columns))
        rows = parts.groupBy("cell").agg(*(F.sum(c).alias(c) for c in columns)).collect()  # SYMBOLS + STATES + 1 rows
        counts = np.zeros((SYMBOLS + STATES + 1, STATES))
        for r in rows:
            counts[r["cell"]] = [r[c] for c in columns]
        p = States.again(counts, unigram)
        sent.unpersist()
    return p


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = for_texts(docs).select("doc_id", "text", F.expr(f"{crc_text('doc_id')} % 7 = 2").alias("held"))
    table = written(_blocks(rows, id_type))
    blocks, words = table.where("kind = 0").select("block", "ids", "held", "counts", "codes"), table.where("kind = 1").select("block", "word", "code", "class", "learnt")
    counted = written(words.where("learnt > 0").groupBy("word", "class").agg(F.sum("learnt").alias("c")))
    ends = rows.where("not held").count()
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counted.orderBy(F.desc("c"), "word").limit(TOP).collect()
    frequent = spark.createDataFrame([(r["word"], i) for i, r in enumerate(top)], "word long, symbol int")
    rest = np.zeros((2, CLASSES))
    for r in counted.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        rest[:, r["class"]] = r["c"], r["v"]
    for r in top:
        rest[:, r["class"]] -= r["c"], 1
    lex = Lexicon(totals["n"] + ends, totals["v"] + (ends > 0), ends, rest[0], rest[1], np.array([r["c"] for r in top], float))
    # The distinct words of a partition are hashed, so the far more rows of all blocks need no sort.
    answers = words.join(counted.select("word", "c").hint("shuffle_hash"), "word", "left").join(F.broadcast(frequent), "word", "left")
    answers = answers.select(F.col("block").alias("own"), "code", "class", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.lit(-1)).alias("symbol"))
    encoded = written(_encode(blocks, answers, spark.sparkContext.broadcast(lex), id_type))
    discard(table, counted)
    sent = spark.sparkContext.broadcast(_learn(encoded, lex.unigram))
    n = lex.tokens

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                held, counts, symbols, known, base, lexical = (_unpack(batch.column(k)[i].as_py(), t) for k, t in enumerate((bool, np.int64, np.int16, np.int64, float, float), 1))
                value = likelihood(symbols, counts, sent.value) + lexical
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(counts), pa.array(known), pa.array(np.full(len(counts), n)), pa.array(base), pa.array(value)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(tidy(score), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
