"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from brindle.llm import importance_resampling as op

WORDS = "alpha Beta GAMMA déjà Über 7 x9 naïve ß 漢字 zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def features(text, run):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return w, [" ".join(w[i : i + m]) for m in range(1, run + 1) for i in range(len(w) - m + 1)]


def plain(docs, bench, run=1, most=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % most
    all_of = lambda texts: [bucket(f) for t in texts for f in features(t, run)[1]]
    raw, target = all_of(t for _, t in docs), all_of(bench)
    s, t = [0] * most, [0] * most
    for b in raw:
        s[b] += 1
    for b in target:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (len(raw) + most) / ((s[b] + 1) * (len(target) + most)))) for b in range(most)]
    rows = []
    for doc_id, text in docs:
        w, f = features(text, run)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def corpus(rng, n):
    texts = [None, "", " !? ", "A", "the The THE " * 30, "é" * 50_000, "a " * 30_000]
    texts += [" ".join(rng.choice(WORDS) + rng.choice(["", ",", "-", "'s", "\n"]) for _ in range(rng.randrange(80))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[-1]), (3, texts[-1]), (3, texts[-1])] + [(1000 + i, texts[-2]) for i in range(60)]


@pytest.mark.parametrize(("run", "most", "percent"), [(1, 10_000, 10), (3, 50, 35), (2, 7, 100)])
def test_ranks_equal_a_plain_version(spark, run, most, percent):
    rows = corpus(random.Random(run), 120)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, rank int").repartition(5)
    bench = [None, "", "alpha beta gamma 漢字", "Zeta eta"]
    got = op.ranked(docs, spark.createDataFrame([(t, 0) for t in bench], "text string, weight int"), run=run, most=most, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, bench, run, most, 20, percent)


def test_drawn_texts_are_those_with_a_rank(spark):
    rows = corpus(random.Random(5), 200)
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, score string")
    bench = spark.createDataFrame([("alpha beta pi rho",)], "text string")
    ranks = [r for r in op.ranked(docs, bench, percent=30).collect() if r["rank"]]
    got = op.drawn(docs, bench, percent=30)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in ranks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan


def test_small_and_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in op.ranked(docs, bench).collect()) == [(1, 3, None), (2, 0, None)]
    assert op.drawn(docs, bench).collect() == [] == op.ranked(docs.where("doc_id > 5"), bench).collect()


def test_target_words_raise_the_weight(spark):
    docs = spark.createDataFrame([(i, ("alpha beta " if i % 2 else "rho pi ") * 20) for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["weight"] for r in op.ranked(docs, spark.createDataFrame([("alpha alpha beta",)], "text string")).collect()}
    assert min(w for i, w in got.items() if i % 2) > max(w for i, w in got.items() if not i % 2)
