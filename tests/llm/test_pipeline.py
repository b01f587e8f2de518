"""The pipeline's stages on small tables: columns, decisions that take effect, and brute force over each stage's own input."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import ppm_language
from brindle.llm.common import table, written

from .brute_lines import brute as brute_lines
from .test_models_and_links import brute_components, plain_bits, plain_trees
from .test_vectors_and_texts import brute_hits


@pytest.fixture(scope="module")
def stages(spark, data):
    """What goes into each stage, and at the end what comes out of the last."""
    out = [table(spark, data, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], data)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_rows(spark, data, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "tokens"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert corpus_pipeline.run(spark, data).count() == stages[-1].count() > 0


def plainly_accepted(before, learnt):
    """Ids of texts with a letter whose best code, by walking contexts, takes at most REJECT_BITS a byte."""
    trees = [plain_trees(t) for t in learnt.values()]
    kept = set()
    for i, t in before.items():
        if any(c.isalpha() for c in t or ""):
            raw = t.encode()
            x, _ = ppm_language.folded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            x = bytes(x)
            if min(plain_bits(tree, x) for tree in trees) <= ppm_language.REJECT_BITS * max(1, len(x) - ppm_language.PAD):
                kept.add(i)
    return kept


def test_language(spark, data, stages):
    before, after = texts(stages[0]), texts(stages[1])
    short = {i: t for i, t in before.items() if len(t) < 4000}
    assert plainly_accepted(short, ppm_language.sample(stages[0])) == set(after) & set(short)


def test_language_rejects_costly_texts(spark, stages):
    """Texts of other scripts and without letters go; REJECT_BITS decides on the border."""
    more = ["日本語のテキスト" * 20, "Это русский текст", "123 456", "", None, "the of and to in ÿÿÿÿÿÿÿÿÿÿ", "ÿ the", "een klein beetje"]
    first = stages[0].select("doc_id", "text", "lang").where("length(text) < 2000")
    frame = first.unionByName(spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(more)], first.schema))
    want = plainly_accepted(texts(frame), ppm_language.sample(frame))
    assert 10**6 + 7 in want and not {10**6 + k for k in range(5)} & want
    assert set(texts(ppm_language.accepted(frame))) == want


def test_odd_rows_through_all_stages(spark, data, stages):
    """Nulls in any column, repeated rows, clashing names and very long texts: every stage runs, and its rule holds on its own input."""
    base = stages[0].where("length(text) < 3000").limit(60)
    long = " ".join(r["text"] for r in base.collect()) * 6
    row = base.first().asDict()
    odd = [(None, row["text"], None, None, None), (10**6, None, "en", None, 3), (10**6 + 1, "", None, "x", 0), (10**6 + 2, long, "en", "x", None), (10**6 + 2, long, "en", "x", None), (row["doc_id"], row["text"], None, None, None), (10**6 + 3, "a" * 300_000, "en", "x", 1)]
    frame = base.unionByName(spark.createDataFrame(odd, base.schema))
    frame = frame.selectExpr("*", "1 as ids", "2 as h", "'k' as k", "3 as node", "true as found", "named_struct('a', 1) as z")
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, data))
        assert docs.columns == frame.columns
        rows = lambda df: {(r["doc_id"], r["source"], r["node"]) for r in df.collect()}
        assert rows(docs) <= rows(before), name
        if name == "language":
            assert not {10**6, 10**6 + 1} & {r["doc_id"] for r in docs.collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert len(out) == docs.count() > 10 and all(r["round_trip"] for r in out)


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = brute_lines(list(before.items()), 25, 50)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}
    assert after == {i: t for i, t in want.items() if not gone[i] or t.split()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_copies(stages):
    before = texts(stages[2])
    assert set(texts(stages[3])) == {i for i, _, c in brute_components(list(before.items())) if i == c}


def test_benchmark(spark, data, stages):
    items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
    before = texts(stages[3])
    hits = brute_hits(list(before.values()), items)
    assert set(texts(stages[4])) == {i for i, h in zip(before, hits) if not h[4]}


def test_tokens(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[4])) and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows)


def test_empty_documents(spark, data):
    docs = table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data))
    assert docs.count() == 0
