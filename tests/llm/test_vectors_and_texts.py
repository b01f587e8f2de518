"""Operators against brute force: top-k, toxicity, pieces, lines, decontamination."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from brindle.llm import norm_topk, subword_toxicity, suffix_decontamination, suffix_sentencepiece, winnowed_lines

from .brute_lines import brute as brute_lines


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# ---- top-k


def brute_topk(rows, k, every):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in fine]
    out = set()
    for q in sorted({i for i, _ in whole if i % every == 0}):
        mine = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in whole if i != q and len(v) == len(mine))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed, pairs", [(1, 1 << 18), (2, 1 << 18), (3, 0)])
def test_topk_equals_brute_force(spark, seed, pairs, monkeypatch):
    monkeypatch.setattr(norm_topk, "PAIRS_MOST", pairs)
    monkeypatch.setattr(norm_topk, "CELL_VECTORS", 100)
    monkeypatch.setattr(norm_topk, "CELL_QUERIES", 3)
    monkeypatch.setattr(norm_topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(norm_topk, "SEEDS", 8)
    rng = np.random.default_rng(seed)
    length = rng.choice([0.1, 1.0, 3.0], 300)
    base = rng.standard_normal((20, 8))
    rows = [(int(i), [float(x) for x in length[i] * (base[i % 20] + 0.05 * (seed - 1) * rng.standard_normal(8))]) for i in range(300)]
    rows += [(7, rows[7][1]), (50, rows[51][1]), (None, rows[0][1]), (400, None), (450, []), (500, [1.0, None]), (550, [float("nan")] * 8), (600, [float("inf")] * 8), (650, [0.5, 0.5]), (651, [0.25, -0.5]), (700, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in norm_topk.topk(frame).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_topk(rows, 5, 50)


def test_short_vectors_are_not_sent(spark, monkeypatch):
    """Vectors of a length that no query can use are dropped before the shuffle."""
    monkeypatch.setattr(norm_topk, "SEEDS", 50)
    rng = np.random.default_rng(1)
    unit = np.abs(rng.standard_normal((2000, 8)))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in (4.0 if i % 10 == 0 else 0.1) * unit[i]], 0) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries, vectors = norm_topk.grid(frame)
    assert vectors.count() < 300 and queries.select("vec_id").distinct().count() == 40
    got = norm_topk.topk(frame)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_topk([r[:2] for r in rows], 5, 50)


def test_topk_of_no_vectors(spark):
    assert norm_topk.topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_products_saturate():
    big = np.array([[2.0**40, 2.0**40]])
    assert norm_topk.products(big, big)[0, 0] == np.iinfo(np.int64).max


# ---- toxicity


def test_toxicity_finds_unseen_misspellings():
    rng = random.Random(5)
    words = ["river", "stone", "light", "green", "walk", "table", "seven", "cloud", "paper", "train"]
    texts, toxic = [], []
    for i in range(400):
        line = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if i % 4 == 0:
            line[rng.randrange(len(line))] = "scoundrel"
            line[rng.randrange(len(line))] = "scoundrel"
        texts.append(" ".join(line))
        toxic.append(i % 4 == 0)
    value, bias = subword_toxicity.train(texts, np.array(toxic))

    def p(t):
        raw = t.encode()
        return float(subword_toxicity.sigmoid(subword_toxicity.Bags(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).logits(value, bias))[0])

    plain = " ".join(words * 3)
    assert p(plain) < 0.5 < p(plain + " scoundrel scoundrel " + plain)
    assert p(plain + " scoundrell scoundrrel") > 0.5
    assert 0 <= p("") <= 1


def test_toxicity_rows_and_odd_labels(spark):
    texts = [None, "", " ", "one two", "one two", "x" * 50_000]
    frame = docs(spark, texts).selectExpr("doc_id", "text", "1 as score", "'x' as predicted")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(3, 1), (3, 0), (99, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = subword_toxicity.scored(frame, labels).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert subword_toxicity.scored(frame.limit(0), odd).count() == 0


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return suffix_sentencepiece.Vocabulary(*suffix_sentencepiece.Vocabulary.load(suffix_sentencepiece.MODEL))


def test_pieces_equal_the_tokenizer(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=suffix_sentencepiece.MODEL)
    rng = random.Random(9)
    letters, mixed = "abcdefghinorstelou", "aeinrst  .,'-_0123{}()<>/\n\téüß日本语🤖ийко\x00"
    pieces = list(vocabulary.text.values())
    texts = ["", " ", "  a", "▁x", "<s>", "<0x0A>", "x" * 3000, " " * 90, "日本語" * 40]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(mixed) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    ids, at = suffix_sentencepiece.encode_texts(pa.array(texts), vocabulary)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == sp.encode(texts)
    back = suffix_sentencepiece.decode_ids(ids, at, vocabulary)
    assert all(b == t.replace("▁", " ") for b, t in zip(back, texts))


def test_long_units_equal_the_tokenizer(vocabulary, monkeypatch):
    """Units relaxed alone, over the edges of segments, among short ones."""
    sp = sentencepiece.SentencePieceProcessor(model_file=suffix_sentencepiece.MODEL)
    monkeypatch.setattr(suffix_sentencepiece, "LONG_UNIT", 12)
    monkeypatch.setattr(suffix_sentencepiece, "SEGMENT", 37)
    rng = random.Random(10)
    letters = ["abcdefghinorstelou", "aeinrst.,'-_0123{}()<>/\n\téüß日本语🤖ийко\x00", "a"]
    texts = ["", " "] + [" ".join("".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    ids, at = suffix_sentencepiece.encode_texts(pa.array(texts), vocabulary)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == sp.encode(texts)


def test_a_word_of_a_million_letters(vocabulary):
    rng = random.Random(1)
    texts = ["a short one", "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=1_000_000)), "x" * 1_000_000]
    began = time.time()
    ids, at = suffix_sentencepiece.encode_texts(pa.array(texts), vocabulary)
    assert time.time() - began < 120
    assert suffix_sentencepiece.decode_ids(ids, at, vocabulary) == texts


def test_columns_of_the_same_names_are_replaced(spark):
    frame = docs(spark, ["Hello world"]).selectExpr("doc_id", "text", "'q' as ids", "1 as n_tokens", "2 as other", "3 as round_trip")
    got = suffix_sentencepiece.encode_columns(frame)
    assert got.columns == ["doc_id", "text", "other", "ids", "n_tokens", "round_trip"] and got.first()["round_trip"] is True


def test_pieces_of_a_table(spark):
    texts = [None, "", "Hello  world", "Hello  world", "▁", "a\r\nb"]
    frame = docs(spark, texts).selectExpr("doc_id", "text", "1 as n_tokens", "'q' as ids")
    got = suffix_sentencepiece.encode(frame)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == 6 and rows[0]["n_tokens"] == 0 and rows[2]["ids"] == rows[3]["ids"] and not rows[4]["round_trip"] and rows[5]["round_trip"]
    assert {r["doc_id"]: r["text"] for r in suffix_sentencepiece.decode(got).collect()} == {0: "", 1: "", 2: texts[2], 3: texts[3], 4: " ", 5: texts[5]}
    assert suffix_sentencepiece.encode(frame.limit(0)).count() == 0


# ---- lines


def lines_case(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    texts = []
    for _ in range(60):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if texts and rng.random() < 0.5:
            source = rng.choice(texts).split("\n")
            cut = rng.randrange(len(source))
            own[rng.randint(0, len(own)) :] = source[cut : cut + rng.randint(1, 8)]
        own = [x for y in own for x in ([y, ""] if rng.random() < 0.1 else [y])]
        texts.append("\n".join(own))
    return [*texts, "same line here again\n" * 40]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    texts = lines_case(seed)
    gone = brute_lines(list(enumerate(texts)), winnowed_lines.GRAM_WORDS, winnowed_lines.RUN_WORDS)
    assert any(gone.values())
    for r in winnowed_lines.deduplicated(docs(spark, texts)).collect():
        kept = [line for i, line in enumerate(texts[r["doc_id"]].split("\n")) if i not in gone[r["doc_id"]]]
        assert (r["text"], r["n_removed"]) == ("\n".join(kept), len(gone[r["doc_id"]]))


def test_shared_passages_lose_their_later_copies(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    texts = [f"intro {i} of this one\n{passage}\nlast line {i}" for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in winnowed_lines.deduplicated(docs(spark, texts)).collect()}
    assert out[0] == texts[0] and all(passage not in out[i] and f"last line {i}" in out[i] for i in range(1, 30))


def brute_repeats(texts, least):
    """Places of lines with words inside a run of so many words that occurs in an earlier place, by comparing all pairs."""
    z = [[(p, x, len(x.split())) for p, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    gone = [set() for _ in texts]
    for i, j in ((i, j) for i in range(len(z)) for j in range(i + 1)):
        for d in range(1 if i == j else 1 - len(z[j]), len(z[i])):
            run = []
            for a in range(max(0, d), len(z[i]) + 1):
                if a < len(z[i]) and a - d < len(z[j]) and z[i][a][1] == z[j][a - d][1]:
                    run.append(z[i][a])
                    continue
                if sum(w for _, _, w in run) >= least:
                    gone[i].update(p for p, _, _ in run)
                run = []
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_no_long_run_of_lines_stays_twice(spark, seed):
    """Runs that repeat between later documents, of lines that earlier ones have as well."""
    rng = random.Random(seed)
    line = [" ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(n)) for k, n in enumerate([30, 30, 60, 8, 26, 26, 12, 55, 5, 40] * 2)]
    texts = [f"own {i} {rng.random()}\n{x}\nend {rng.random()}" for i, x in enumerate(line)]
    for i in range(60):
        part = [rng.randrange(len(line) - 4) for _ in range(3)]
        texts.append("\n".join(f"before {i} {a}\n" + "\n".join(line[a : a + rng.randint(1, 4)]) for a in part))
    want = brute_repeats(texts, winnowed_lines.RUN_WORDS)
    rule = brute_lines(list(enumerate(texts)), winnowed_lines.GRAM_WORDS, winnowed_lines.RUN_WORDS)
    assert any(w - rule[i] for i, w in enumerate(want))
    for r in winnowed_lines.deduplicated(docs(spark, texts)).collect():
        i = r["doc_id"]
        assert r["text"] == "\n".join(x for p, x in enumerate(texts[i].split("\n")) if p not in want[i] | rule[i])


def test_lines_of_very_long_texts(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    shared = [line() for _ in range(20)]
    long = [x for k in range(2000) for x in ([line()] if k % 50 else [line(), *shared])]
    texts = ["\n".join(shared), "\n".join(long), "x " * 300_000, "\n".join(["x " * 300_000, "tail"]), "a" * 1_000_000, "\n" * 200_000]
    got = {r["doc_id"]: r for r in winnowed_lines.deduplicated(docs(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == "\n".join(x for x in long if x not in set(shared)) and got[1]["n_removed"] == 40 * 20
    assert got[3]["text"] == "tail" and all(got[i]["text"] == texts[i] for i in (2, 4, 5))


def test_line_dedup_runs_no_python(spark):
    frame = winnowed_lines.deduplicated(docs(spark, ["a b\nc d"] * 3))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_odd_rows(spark):
    block = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(5))
    rows = [(1, block), (1, block), (2, block), (None, block), (3, None), (4, ""), (5, "\n\n")]
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, h string, n_chars long")
    got = winnowed_lines.deduplicated(frame).collect()
    by = {(r["doc_id"], r["text"]) for r in got}
    assert len(got) == 7 and by == {(None, block), (1, ""), (2, ""), (3, None), (4, ""), (5, "\n\n")}
    kept = winnowed_lines.without_repeats(frame)
    assert kept.columns == frame.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5]
    assert winnowed_lines.deduplicated(frame.limit(0)).count() == 0


# ---- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            x = words(item)
            n = min(window, len(x))
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(4)
    alphabet = ["The", "of", "and", "Ünit", "x1", "straße", "red", "blue"]
    items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 10, 11, 30])) )) for i in range(8)]
    items = [x for x in items if len(words(x[1])) > 4] + [(20, ""), (21, None), (9, "zebra lion"), (9, "Zebra, lion")]
    texts = [None, "", "...", "zebra LION", "zebra lion " * 30]
    for _ in range(80):
        w = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            x = (rng.choice(items)[1] or "").split(" ")
            cut = rng.randrange(len(x))
            w[rng.randint(0, len(w)) :] = x[cut:]
        texts.append(", ".join(w))
    bench = spark.createDataFrame(items + [(None, "red")], "item_id long, text string")
    frame = docs(spark, texts).selectExpr("doc_id", "text", "true as contaminated", "7 as n_words")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in suffix_decontamination.report(frame, bench, block_bytes=block).collect()}
    want = brute_hits(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    clean = suffix_decontamination.decontaminate(frame, bench, block_bytes=block)
    assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i, w in enumerate(want) if not w[4]]


def brute_longest(text, items, window=10):
    """(words, place, id) of the longest common run of words that has a window's length or is a whole shorter item."""
    w, best = words(text), None
    for name, item in items:
        x = words(item)
        least = min(window, len(x))
        for i in range(len(w)):
            for j in range(len(x)):
                k = 0
                while i + k < len(w) and j + k < len(x) and w[i + k] == x[j + k]:
                    k += 1
                if k and k >= least:
                    best = min(best or (1, "", 0), (-k, str(name), i)) if best else (-k, str(name), i)
    return (-best[0], best[2], best[1]) if best else (0, None, None)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_longest_matches_equal_brute_force(spark, block):
    rng = random.Random(8)
    alphabet = ["a", "b", "c", "dd"]
    items = [(i, " ".join(rng.choice(alphabet) for _ in range(n))) for i, n in enumerate([3, 12, 12, 20, 25, 40, 9])] + [(40, "a " * 15), (5, "b a " * 10)]
    texts = ["a " * 50, "", None, "b a " * 12 + "c"]
    for _ in range(40):
        w = [rng.choice(alphabet) for _ in range(rng.randint(0, 40))]
        x = rng.choice(items)[1].split()
        cut = rng.randrange(len(x))
        w[rng.randint(0, len(w)) :] = x[cut : cut + rng.randint(1, 40)] * rng.randint(1, 3)
        texts.append(" ".join(w))
    texts.append(texts[-1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_decontamination.report(docs(spark, texts), bench, block_bytes=block).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["longest_words"], r["longest_at"], r["longest_item"]) == brute_longest(texts[r["doc_id"]], items), r


@pytest.mark.parametrize("seed", range(4))
def test_templates_are_followed_without_pairs(seed, monkeypatch):
    """Items and documents that share text by many: matches and digests equal those of all pairs; no pair list is long."""
    r = random.Random(seed)
    stem = [f"s{k}" for k in range(14)]
    bodies = [stem[r.randrange(3) :] + [r.choice("abc") for _ in range(r.randrange(9))] for _ in range(60)]
    texts = [" ".join(r.choices("xyz", k=r.randrange(4)) + r.choice(bodies)[: r.randrange(9, 24)] + r.choices("xyzab", k=r.randrange(5))) for _ in range(80)]
    ids = [f"i{k}" for k in range(len(bodies))]
    monkeypatch.setattr(suffix_decontamination, "PAIRS", 2)
    made, real = [], suffix_decontamination.Descent.pairs
    monkeypatch.setattr(suffix_decontamination.Descent, "pairs", lambda self: made.append((len(self.start) + len(self.place), out := real(self))) or out)
    got = suffix_decontamination.scan_step(pa.array(texts), suffix_decontamination.Items(ids, [" ".join(b) for b in bodies], 10))
    assert max(given for given, _ in made) > 100 and all(len(out[0]) <= 2 * given for given, out in made)
    short = suffix_decontamination.scan_step(pa.array(texts), suffix_decontamination.Items(ids, [" ".join(b) for b in bodies], 10), suffix_decontamination.digested)
    for text, found, digest in zip(texts, got, short):
        words = text.split()
        best, names = (0, None, None), set()
        for name, body in zip(ids, bodies):
            least = min(10, len(body))
            for a in range(len(body) - least + 1):
                for p in range(len(words) - least + 1):
                    n = 0
                    while a + n < len(body) and p + n < len(words) and body[a + n] == words[p + n]:
                        n += 1
                    if n >= least:
                        names.add(name)
                        best = min(best, (-n, name, p))
        assert found["items"] == sorted(names)
        assert (-found["longest"], found["longest_item"], found["longest_at"]) == best
        assert digest["n_items"] == len(names) and digest["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_a_template_of_many_items_and_documents_is_quick():
    items = suffix_decontamination.Items([f"i{k}" for k in range(20_000)], [" ".join(f"t{j}" for j in range(14)) + f" own{k}" for k in range(20_000)], 10)
    texts = pa.array([" ".join(f"t{j}" for j in range(14)) + f" own{k} and more" for k in range(5000)])
    began = time.time()
    got = suffix_decontamination.scan_step(texts, items, suffix_decontamination.digested)
    assert time.time() - began < 20
    assert all(x["n_items"] == 20_000 and (x["longest"], x["longest_item"]) == (15, f"i{k}") for k, x in enumerate(got))


def test_a_long_item_found_whole_is_quick():
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    again = "so it goes on and on " * 4000
    items = suffix_decontamination.Items(["x", "y"], [item, again], 10)
    began = time.time()
    found = suffix_decontamination.scan_step(pa.array([f"a b {item} c", f"q {again} r", item[: len(item) // 2] + " z " + item]), items)
    assert time.time() - began < 10
    assert [(x["longest"], x["longest_item"], x["longest_at"]) for x in found[:2]] == [(20_000, "x", 2), (24_000, "y", 1)] and found[2]["longest"] == 20_000


def test_decontamination_of_very_long_texts():
    item = "one two three four five six seven eight nine ten"
    items = suffix_decontamination.Items(["q"], [item], 10)
    texts = ["w " * 400_000 + item + " w" * 10, "a" * 2_000_000, item.replace(" ", "  ")]
    found = suffix_decontamination.scan_step(pa.array(texts), items)
    assert [(x["n_words"], x["hits"], x["longest_at"]) for x in found] == [(400_020, [400_000, 400_010], 400_000), (1, [], None), (10, [0, 10], 0)]


def test_blocks_run_one_python_node_a_stage(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(40)]
    texts = [f"lead {x} tail" if k % 3 == 0 else "clean " * 20 for k, (_, x) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = suffix_decontamination.decontaminate(docs(spark, texts), bench, block_bytes=sum(len(x) for _, x in items) // 10 + 1)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r["doc_id"] for r in clean.collect()} == {k for k in range(40) if k % 3}


def test_longest_match_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    frame = docs(spark, ["a b " + " ".join(f"w{i}" for i in range(3, 25)) + " c"])
    r = suffix_decontamination.report(frame, bench).first()
    assert (r["longest_words"], r["longest_at"], r["longest_item"]) == (22, 2, "q")
    assert not suffix_decontamination.report(frame, bench.limit(0)).first()["contaminated"]
    assert suffix_decontamination.report(frame.limit(0), bench).count() == 0
