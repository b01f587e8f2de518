"""Operators against brute force or held-out figures: language model, personal data, language, near copies, secrets."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import credential_linking, hmm_language_model, multi_order_jaccard, ppm_language, weak_pii
from brindle.llm.common import text_buffers, table
from brindle.llm.components import components


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def crc(i):
    return zlib.crc32(str(i).encode())


# ---- language model


def plain_counts(texts, p):
    """log10 likelihoods and expected counts by forward-backward over whole texts, one token after another."""
    m, s = hmm_language_model.SYMBOLS, hmm_language_model.STATES
    out, logs = np.zeros((m + s + 1, s)), []
    for x in texts:
        f, scale = [], []
        for t, y in enumerate(x):
            a = (p.start if t == 0 else f[-1] @ p.move) * p.emit[y]
            scale.append(a.sum())
            f.append(a / a.sum())
        logs.append(sum(math.log10(v) for v in scale))
        b = np.ones(s)
        for t in range(len(x) - 1, -1, -1):
            g = f[t] * b / (f[t] @ b)
            out[x[t]] += g
            if t == 0:
                out[m + s] += g
            else:
                c = p.emit[x[t]] * b
                both = f[t - 1][:, None] * p.move * c
                out[m : m + s] += both / both.sum()
                b = p.move @ c
                b /= b.sum()
    return logs, out


@pytest.mark.parametrize("window, held", [(1 << 12, 1 << 18), (50, 1 << 18), (7, 60), (1, 5)])
def test_hmm_recursions_equal_plain_ones(monkeypatch, window, held):
    rng = np.random.default_rng(0)
    p = hmm_language_model.States.first(rng.dirichlet(np.ones(hmm_language_model.SYMBOLS)))
    p.start, p.move = rng.dirichlet(np.ones(hmm_language_model.STATES)), rng.dirichlet(np.ones(hmm_language_model.STATES) * 0.3, hmm_language_model.STATES) * 0.999 + 0.001 / hmm_language_model.STATES
    counts = np.array([1, 5, 300, 64, 65, 2, 1, 50, 51, 100])
    seq = rng.integers(0, hmm_language_model.SYMBOLS, counts.sum()).astype(np.int16)
    monkeypatch.setattr(hmm_language_model, "WINDOW", window)
    monkeypatch.setattr(hmm_language_model, "SLICE", held)
    logs, want = plain_counts(np.split(seq, np.cumsum(counts)[:-1]), p)
    assert np.allclose(hmm_language_model.likelihood(seq, counts, p), logs, rtol=1e-10)
    got = hmm_language_model.expected(seq, counts, p)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5)
    n = hmm_language_model.SYMBOLS
    assert np.isclose(got[:n].sum(), counts.sum()) and np.isclose(got[n : n + hmm_language_model.STATES].sum(), (counts - 1).sum()) and np.isclose(got[n + hmm_language_model.STATES :].sum(), len(counts))


def test_hmm_counts_of_texts_that_contradict_the_states():
    """States that hardly ever change, and symbols that each want another one: products of floats would vanish."""
    s, m = hmm_language_model.STATES, hmm_language_model.SYMBOLS
    emit = np.full((m, s), 1e-12)
    emit[np.arange(s), np.arange(s)] = 1.0
    move = (1 - hmm_language_model.MIX) * np.eye(s) + hmm_language_model.MIX / s
    p = hmm_language_model.States(np.full(s, 1 / s), move, emit / emit.sum(axis=0))
    counts = np.array([40, 5000, 1])
    seq = (np.arange(counts.sum()) % s).astype(np.int16)
    logs, want = plain_counts(np.split(seq, np.cumsum(counts)[:-1]), p)
    got = hmm_language_model.expected(seq, counts, p)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-5)
    assert np.allclose(hmm_language_model.likelihood(seq, counts, p), logs, rtol=1e-10)


def test_training_raises_the_likelihood():
    """Each round of Baum-Welch, from counts over texts that are longer than a window, is no worse than the one before."""
    rng = np.random.default_rng(4)
    hidden = np.repeat(rng.integers(0, 4, 900), 10)
    seq = (hidden * 500 + rng.integers(0, 40, len(hidden))).astype(np.int16)
    counts = np.array([5000, 4000])
    unigram = np.bincount(seq, minlength=hmm_language_model.SYMBOLS) + 0.01
    unigram = unigram / unigram.sum()
    p, values = hmm_language_model.States.first(unigram), []
    for _ in range(6):
        values.append(hmm_language_model.likelihood(seq, counts, p).sum())
        p = hmm_language_model.States.again(hmm_language_model.expected(seq, counts, p), unigram)
    assert all(b > a - 1 for a, b in zip(values, values[1:])) and values[-1] > values[0] + 1000


def test_two_state_forward_sums_to_one():
    """All sequences of a tiny alphabet: their probabilities add up to one."""
    rng = np.random.default_rng(3)
    s = hmm_language_model.STATES
    emit = rng.random((3, s))
    p = hmm_language_model.States(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), emit / emit.sum(axis=0))
    seqs = list(itertools.product(range(3), repeat=4))
    got = hmm_language_model.likelihood(np.array(seqs, np.int16).ravel(), np.full(len(seqs), 4), p)
    assert math.isclose((10**got).sum(), 1, rel_tol=1e-9)


def test_language_model_counts_and_held_out_gain(spark, data):
    extra = docs(spark, [None, "", " \t\n", "The the THE", "é É", "x" * 30_000], 10_000)
    frame = table(spark, data, "documents").select("doc_id", "text").unionByName(extra).selectExpr("doc_id", "text", "1 as score", "2 as held")
    rows = frame.collect()
    split = re.compile(rb"[^\x20\x09-\x0D]+")
    tokens = {r["doc_id"]: [*split.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode())), None] for r in rows}
    count = collections.Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    got = hmm_language_model.scored(frame).collect()
    assert len(got) == len(rows)
    gain = []
    for r in got:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"]) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
        if r["held_out"] and len(ws) > 30:
            gain.append(r["score"] > r["base_score"])
    assert np.mean(gain) > 0.9


def test_language_model_of_nothing(spark):
    assert hmm_language_model.scored(docs(spark, ["a"]).limit(0)).count() == 0


# ---- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.1-+ 25()%é\n4") for _ in range(rng.randint(0, 60)))
        assert weak_pii.base_spans(t) == brute_pii(t), t


def test_base_spans_of_long_runs_are_quick():
    for run in ("a" * 200_000, "1" * 200_000, "@" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" + " " * 100_000):
        weak_pii.candidates(run, weak_pii.base_spans(run))


def test_reliable_votes_add_spans(spark):
    good = [f"please call my phone: (415) 555-{1000 + i} today" for i in range(60)]
    bad = [f"the part 415-555-{1000 + i}% of it" for i in range(60)]
    plain = ["é mail a.b@c.de and 10.0.0.1 or +49 170 1234567, card 4111 1111 1111 1111", None, "", "same", "same"]
    frame = docs(spark, good + bad + plain).selectExpr("doc_id", "text", "1 as spans", "2 as base")
    got = {r["doc_id"]: r for r in weak_pii.scan(frame).collect()}
    assert all("local_phone" in got[i]["spans"] for i in range(60)) and not any("local_phone" in got[i]["spans"] for i in range(60, 120))
    base = ",".join(f"{weak_pii.BASE[k]}:{a}:{b}" for a, k, b in brute_pii(plain[0]))
    assert got[120]["spans"] == base and got[120]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert [got[120][f"n_{k}"] for k in weak_pii.BASE] == [1, 1, 1, 1] and got[121]["spans"] == got[122]["spans"] == ""
    assert weak_pii.scan(frame.limit(0)).count() == 0


def plain_em(rows, rounds):
    """EM for one kind over single candidates (tuples of votes): reliabilities, prior and posteriors."""
    m, yes, no = len(weak_pii.LABELERS), weak_pii.YES, weak_pii.NO
    p = [1 / (1 + math.exp(-sum(v - 1 for v in r))) for r in rows]
    for _ in range(rounds):
        table = []
        for i in range(m):
            t = [[1 + sum((x if y else 1 - x) for r, x in zip(rows, p) if r[i] == v) for v in range(3)] for y in (0, 1)]
            t = [[a / sum(u) for a in u] for u in t]
            t[1][yes], t[0][no] = max(t[1][yes], t[0][yes]), max(t[0][no], t[1][no])
            table.append([[a / sum(u) for a in u] for u in t])
        prior = min(0.95, max(0.05, sum(p) / len(p)))
        p = [1 / (1 + (1 - prior) / prior * math.prod(table[i][0][v] / table[i][1][v] for i, v in enumerate(r))) for r in rows]
    return table, prior, p


def test_em_equals_a_plain_version():
    rng = random.Random(4)
    counts = collections.Counter()
    rows = {4: [], 7: []}
    for kind in rows:
        for _ in range(300):
            true = rng.random() < 0.4
            votes = tuple(rng.choices((2, 1, 0), (6, 3, 1) if true else (1, 4, 3))[0] for _ in weak_pii.LABELERS)
            rows[kind].append(votes)
            counts[kind, sum(v * 3**i for i, v in enumerate(votes))] += 1
    silent = sum(3**i for i in range(len(weak_pii.LABELERS)))
    got = weak_pii.Aggregation(sorted([(k, v, n) for (k, v), n in counts.items()] + [(5, silent, 9)]), rounds=25)
    for kind, own in rows.items():
        table, prior, p = plain_em(own, 25)
        assert np.allclose(got.reliability[kind], table, rtol=1e-9) and math.isclose(got.prior[kind], prior, rel_tol=1e-9)
        for votes, x in zip(own, p):
            assert math.isclose(got.posterior[kind, sum(v * 3**i for i, v in enumerate(votes))], x, rel_tol=1e-9, abs_tol=1e-12)
    assert got.posterior[5, silent] == 0 and 5 not in got.reliability  # no vote for it: never added
    assert weak_pii.Aggregation([]).posterior == {}


def planted_pii(rng):
    """Texts with the spans that are personal data, by kind; the other candidates look alike but aren't."""
    iban = lambda ok: "DE" + next(f"{c:02d}" for c in range(2, 99) if (int("370400440532013000131400") + c) % 97 == (1 if ok else 5)) + " 3704 0044 0532 0130 00"
    surnames = ["Kowalski", "Lindgren", "Moreau"]
    pick = [
        ("local_phone", lambda k: (f"please call {rng.choice(['me', 'us', 'Ann'])} at my phone ", f"415-555-{2000 + k}", " any day")),
        ("local_phone", lambda k: ("you can ring ", f"415 555 {2000 + k}", " any day")),  # no cue word: the classifier's
        (None, lambda k: ("the part ", f"415-555-{2000 + k}", "% in stock")),
        ("national_id", lambda k: ("with ssn ", f"123-45-{1000 + k}", " on file")),
        (None, lambda k: ("page ", f"000-45-{1000 + k}", " is lost")),
        ("iban", lambda k: ("pay to account ", iban(True), " today")),
        (None, lambda k: ("see section ", iban(False), " there")),
        ("birth_date", lambda k: ("she was born ", f"{1 + k % 28}.{1 + k % 12}.19{10 + k % 89}", ", they say")),
        (None, lambda k: ("a release of version ", f"{1 + k % 28}.{1 + k % 12}.1899", " came")),
        ("spelled_email", lambda k: ("write to ", f"user{k} [at] mail{k} [dot] org", " soon")),
        ("person", lambda k: ("we met ", f"Dr. Anna {rng.choice(surnames)}", " there")),
        ("person", lambda k: ("we met ", f"Eva {rng.choice(surnames)}", " there")),  # only the learnt gazetteer knows
    ]
    texts, truth = [], set()
    for k in range(600):
        kind, make = pick[k % len(pick)]
        before, span, after = make(k)
        lead = "words that say little " * rng.randint(0, 3)
        if rng.random() < 0.2 and kind == "local_phone" and "ring" not in before:
            before = "call and ring "
        texts.append(lead + before + span + after)
        if kind:
            truth.add((k, kind, len(lead + before), len(lead + before + span)))
    return texts, truth


def test_precision_and_recall_of_added_spans(spark):
    texts, truth = planted_pii(random.Random(12))
    added = set()
    for r in weak_pii.scan(docs(spark, texts)).collect():
        for x in filter(None, r["spans"].split(",")):
            kind, a, b = x.split(":")
            if kind in weak_pii.ADDED:
                added.add((r["doc_id"], kind, int(a), int(b)))
    hit = len(added & truth)
    assert hit / len(added) >= 0.95 and hit / len(truth) >= 0.9, (sorted(added - truth)[:5], sorted(truth - added)[:5], hit, len(added), len(truth))
    for kind in weak_pii.ADDED:
        assert sum(x[1] == kind for x in added & truth) >= 0.5 * sum(x[1] == kind for x in truth), kind


def test_no_votes_for_a_kind_add_nothing(spark):
    got = weak_pii.scan(docs(spark, [f"it was on 1.1.{3000 + k} and so" for k in range(20)])).collect()
    assert all(r["spans"] == "" for r in got)


# ---- language


def plain_trees(model_texts):
    order = ppm_language.ORDER
    counts = collections.defaultdict(collections.Counter)
    for t in model_texts:
        raw = t.encode()
        y, _ = ppm_language.folded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        y = bytes(y)
        for i in range(ppm_language.PAD, len(y)):
            for k in range(order):
                counts[y[i - k : i]][y[i]] += 1
    return {c: (own, sum(own.values()) + len(own)) for c, own in counts.items()}


def plain_bits(trees, x):
    """Code length of folded bytes by walking contexts, with counts in dictionaries."""
    order, total = ppm_language.ORDER, 0.0
    for i in range(ppm_language.PAD, len(x)):
        for k in range(order - 1, -1, -1):
            c, every = trees.get(x[i - k : i], (None, 0))
            if c is None:
                continue
            if x[i] in c:
                total += math.log2(every / c[x[i]])
                break
            total += math.log2(every / len(c))
        else:
            total += 8.0
    return total


@pytest.mark.parametrize("group", [1, 2, 16])
def test_code_lengths_are_exact(monkeypatch, group):
    monkeypatch.setattr(ppm_language, "GROUP", group)
    learnt = {"a": ["the cat sat on the mat, the end", "a", "", "then the dog"], "b": ["le chat est sur la table", "été", "la la"], "c": ["..."]}
    model = ppm_language.Model(learnt)
    texts = ["the cat", "sur la", "zzz éé", "", "  ", "A1b2", "日本語"]
    data, at = text_buffers(pa.array(texts))
    x, new = ppm_language.folded(data, at)
    got = model.bits(x, new)
    for j, name in enumerate("abc"):
        for i in range(len(texts)):
            assert math.isclose(got[i, j], plain_bits(plain_trees(learnt[name]), bytes(x[new[i] : new[i + 1]])), rel_tol=1e-5, abs_tol=1e-6)


def test_costs_make_a_code():
    """In any context the probabilities of all bytes add up to at most one."""
    texts = ["the cat sat on the mat, the end", "then the dog", "été"]
    model = ppm_language.Model({"a": texts})
    for context in (b"   ", b"the", b" th", b"zqx", b"he ", "té".encode()):
        keys = np.array([int.from_bytes(context[-3:] + bytes([b]), "big") for b in range(256)], np.uint32)
        assert np.exp2(-model.groups[0].costs(keys).astype(float)).sum() <= 1 + 1e-5
    assert np.exp2(-model.groups[0].cost[0].astype(float)).sum() <= 1 + 1e-6


def test_languages_of_very_long_and_odd_texts(spark):
    model = ppm_language.Model({"en": ["the cat sat on the mat and the dog ran to the house"] * 3, "fr": ["le chat est sur la table et le chien va à la maison"] * 3})
    texts = ["the dog " * 200_000, "le chien " * 200_000, "z" * 1_000_000, "\x00\x01a", "日本語" * 1000]
    got = ppm_language.identify(docs(spark, texts), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert (by[0]["__brindle_lang"], by[1]["__brindle_lang"]) == ("en", "fr") and all(0 < r["__brindle_score"] <= 1 for r in got)
    assert by[0]["__brindle_bits"] < 3 and by[4]["__brindle_bits"] > ppm_language.REJECT_BITS  # a script that no language has


def test_ties_go_to_the_smaller_language(spark):
    model = ppm_language.Model({"b": ["same text here"], "a": ["same text here"]})
    row = ppm_language.identify(docs(spark, ["same text"]), model).first()
    assert (row["__brindle_lang"], row["__brindle_score"]) == ("a", 0.5)


def test_language_held_out_accuracy_and_odd_rows(spark, data):
    source = table(spark, data, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90_000, None, "en"), (90_001, "123 %%", "en"), (90_002, "", None), (None, "the cat", None), (90_004, "日本語", "fr")], source.schema)
    frame = source.unionByName(odd).selectExpr("*", "1 as score", "2 as lang_pred")
    got = ppm_language.predict(frame).collect()
    truth = {r["doc_id"]: r["lang"] for r in source.collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(truth) + 5 and np.mean(held) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (90_000, 90_001, 90_002)) and by[90_004]["lang_pred"] != "und"
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got if r["doc_id"] is not None)
    kept = ppm_language.accepted(frame)
    assert kept.columns == frame.columns and not {90_000, 90_001, 90_002} & {r["doc_id"] for r in kept.collect()}
    assert ppm_language.predict(frame.limit(0)).count() == 0


def test_sample_is_bounded_for_many_languages_and_long_rows(spark, monkeypatch):
    monkeypatch.setattr(ppm_language, "TOTAL", 1 << 20)
    rows = [(10 * k + j, f"word{k} \u00e9\u65e5 " * 3000, f"l{k:03}") for k in range(300) for j in range(6)]
    got = ppm_language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    size = {name: sum(len(t.encode()) for t in texts) for name, texts in got.items()}
    most = ppm_language.TOTAL // len(size)
    assert set(size) == {lang for i, _, lang in rows if crc(i) % 5} and len(size) > 290  # none is left out
    assert all(0 < n <= 1.5 * most for n in size.values()) and sum(size.values()) <= 1.5 * ppm_language.TOTAL
    assert all(len(t) <= most // 8 and t in f"word{int(name[1:])} \u00e9\u65e5 " * 3000 for name, texts in got.items() for t in texts)


def test_rows_that_repeat_are_learnt_once(spark):
    rows = [(1, "the cat sat", "en")] * 5000 + [(i, f"the dog {i} ran", "en") for i in range(2, 40)]
    got = ppm_language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10_000)
    assert sorted(got["en"]) == sorted({t for i, t, _ in rows if crc(i) % 5})
    few = ppm_language.sample(spark.createDataFrame(rows[5000:] * 50, "doc_id long, text string, lang string"), 8)
    assert 0 < len(few["en"]) < 25


# ---- near copies


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed, most", [(1, 1 << 21), (2, 1 << 21), (3, 0)])
def test_near_copies_equal_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(multi_order_jaccard, "GLOBAL", 3)
    monkeypatch.setattr(multi_order_jaccard, "FILTER_MOST", most)  # 0: texts are picked by a join
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = [None, "", "  ", "one two", "One TWO", "one two three"]
    for _ in range(8):  # groups of copies, edited so that links are often near the threshold
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 80, 150]))]
        for _ in range(rng.choice([2, 6, 15])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    for _ in range(15):  # a common passage with some words of one's own
        own = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        texts.append(" ".join(shared + own if rng.random() < 0.5 else own + shared))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i]) for k, i in enumerate(order)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, kind int")
    got = sorted(tuple(r) for r in multi_order_jaccard.near_copies(frame).select("doc_id", "n_shingles", "component_id").collect())
    want = brute_components(rows)
    assert got == want
    kept = multi_order_jaccard.first_copies(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in want if i == c]


def test_linked_sets_pass_every_filter():
    """Sets of a similarity of 0.8 or more share a prefix token in every order, and their bitmaps allow it; others mostly don't."""
    rng = np.random.default_rng(5)
    passed = []
    for n in (1, 2, 5, 40, 41, 300, 2000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= rng.choice([0, 0.05, 0.1, 0.2, 0.9])], rng.integers(0, 1 << 63, rng.integers(0, 2 + n // 8)).astype(np.uint64)]))
            if not len(b):
                continue
            x, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            (p, q), (s, t) = multi_order_jaccard.prefixes(x, at), multi_order_jaccard.parity(x, at)
            common = len(np.intersect1d(a, b))
            linked = 100 * common >= 80 * (len(a) + len(b) - common)
            got = multi_order_jaccard.share_in_all(p, q) and multi_order_jaccard.may_be_similar(len(a), len(b), s, t)
            assert multi_order_jaccard.similar(a, b) == linked and (got or not linked)
            if not linked:
                passed.append(got)
    assert np.mean(passed) < 0.3


def test_shared_rows_of_any_batches():
    """Rows of tokens that several nodes have, however they are cut to batches; heavy tokens always; each once."""
    rng = random.Random(7)
    for _ in range(200):
        rows = sorted((rng.randrange(6), rng.randrange(4), 0) for _ in range(rng.randint(1, 30)))
        heavy = {t for t in range(6) if rng.random() < 0.2}
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(rng.randint(0, 8)))})
        table_ = [(t, n, p, t in heavy) for t, n, p in rows]
        names = ["token", "node", "place", "often"]
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in table_[a:b]], schema=pa.schema([("token", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("often", pa.bool_())])) for a, b in zip(cuts, cuts[1:])]
        got = [(r["token"], r["node"]) for batch in multi_order_jaccard._shared(iter(batches)) for r in batch.to_pylist()]
        nodes = collections.defaultdict(set)
        for t, n, _ in rows:
            nodes[t].add(n)
        assert sorted(got) == sorted((t, n) for t in nodes for n in nodes[t] if t in heavy or len(nodes[t]) > 1)


# ---- connected components


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(3)
    chain = list(range(0, 300))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, 1000 + k) for k in range(1, 200)] + [(2000, 2001), (2001, 2000), (2001, 2001), (-5, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: -5 for k in range(300)} | {k: 1000 for k in range(1000, 1200)} | {2000: 2000, 2001: 2000, -5: -5}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_odd_rows(spark):
    frame = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "x")], "doc_id long, text string")
    got = [tuple(r) for r in multi_order_jaccard.near_copies(frame).collect()]
    assert sorted(got, key=repr) == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (1, 1, 1)], key=repr)
    assert multi_order_jaccard.near_copies(frame.limit(0)).count() == 0


def test_near_copies_of_very_long_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**5)}" for _ in range(150_000)]
    texts = [" ".join(long), " ".join(long[:-500] + ["x"] * 20), " ".join(long[:60_000]), "a" * 500_000, "a" * 500_000, "b c " * 100_000]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in multi_order_jaccard.near_copies(docs(spark, texts)).collect()}
    assert {i: c for i, (_, c) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5} and got[3][0] == 1 and got[5][0] == 2 and got[0][0] > 149_000


def test_near_copies_link_through_a_null_id(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[8:]), " ".join(words[16:] + ["x0", "x1", "x2", "x3", "x4", "x5"])]
    assert len({c for _, _, c in brute_components([(1, texts[0]), (2, texts[2])])}) == 2
    frame = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in multi_order_jaccard.near_copies(frame).collect()} == {1: 1, None: 1, 2: 1}


def test_first_copies_of_an_id_with_different_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (5, text + " end"), (5, "a text that has nothing to do with it"), (5, None), (6, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, multi_order_jaccard.first_copies(frame).collect()), key=repr) == sorted([rows[0], rows[2], rows[3]], key=repr)


# ---- secrets

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def brute_linked(t):
    weak = [(m.start(), k, m.end()) for k, (name, (pattern, _, _)) in enumerate(credential_linking.WEAK.items(), 3) for m in re.finditer(re.sub(r"\(\?i:", "(?i:", pattern), t)]
    kinds = list(credential_linking.RANK)
    parts = [(a, credential_linking.ROLE[kinds[k]]) for a, k, _ in brute_secrets(t) + weak]
    near = lambda a, role: any(r == role and abs(b - a) <= credential_linking.SCOPE for b, r in parts)
    need = {3: lambda a: near(a, "secret"), 4: lambda a: near(a, "identifier") or near(a, "endpoint"), 5: lambda a: near(a, "identifier") and near(a, "secret")}
    return sorted(brute_secrets(t) + [w for w in weak if need[w[1]](w[0])])


def test_secrets_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "TOKEN=", "secret: ", "passwd='", "api_key", ":", "=", " ", "abc123", "a" * 30, "0f" * 12, "AKIA", "AKIA" + "Z9" * 9, "é", "\n", "x" * 150, "user=bob", "login: ann", "pwd=hunter22", "pass: q1w2e3r4", "https://db.example/x", "host=db1", "日本"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "user=bob pwd=hunter22", "user=bob pwd=hunter22", "z" * 60_000 + "token=abcdef"]
    frame = docs(spark, texts).selectExpr("doc_id", "text", "1 as k", "2 as spans")
    names = list(credential_linking.RANK)
    told = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    got = credential_linking.scan(frame).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        base = brute_secrets(t)
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest() and r["spans"] == told(brute_linked(t)), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
    assert credential_linking.scan(frame.limit(0)).count() == 0


def test_secrets_of_texts_with_many_matches(spark):
    texts = ["password=abcdef12 user=bob " * n for n in (63, 64, 65, 128, 129)] + ["x " * 50_000 + "token=abcdef " * 20_000]
    names = list(credential_linking.RANK)
    began = time.time()
    for r in credential_linking.scan(docs(spark, texts)).collect():
        want = brute_secrets(texts[r["doc_id"]])
        assert r["n_assign"] == len(want) and r["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert time.time() - began < 60


def test_secret_scan_runs_no_python(spark):
    frame = credential_linking.scan(docs(spark, ["user=bob pwd=hunter22"]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
