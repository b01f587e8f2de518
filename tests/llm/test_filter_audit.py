"""The filter audit against a plain version that applies every order to every document."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from brindle.llm import filter_audit as op


def fails(rows):
    """The letters that each row (doc_id, text, source) fails."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = {"A"} if len(words) < 50 else set()
        found |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        found |= {"D"} if re.search("[#$%&*|]", text) else set()
        found |= {"E"} if doc_id is not None and doc_id > least[text] else set()
        out.append(found)
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    parts = defaultdict(list)
    for (doc_id, _, source), found in zip(rows, fails(rows)):
        parts[source or ""].append((doc_id, found))
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                goes = [i for i, x in docs if f in x and not x & before]
                shapley[part, f] += len(goes)
                out[part, "".join(order), step] = [
                    sum(not x & (before | {f}) for _, x in docs), len(goes), sum(f in x and bool(x & before) for _, x in docs), sum(x == {f} for _, x in docs),
                    sum(i in good for i in goes), sum(i in toxic for i in goes),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(rng, n):
    kinds = [
        lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(40, 120))), lambda: "same same same " * rng.randrange(30), lambda: "LOUD Words ÄÖ " * rng.randrange(1, 30),
        lambda: "a\x0bb\x0cc\x1cd\xa0e f " * 12, lambda: rng.choice(["", " ", "#", "x | y", "\x00", "漢字 é"]), lambda: None,
    ]
    rows = [(i, rng.choice(kinds)(), rng.choice(["web", "web", "news", None, ""])) for i in range(n)]
    rows += [(rng.randrange(2 * n), rng.choice(rows)[1], rng.choice(["web", "books"])) for _ in range(n)]  # copies and repeated ids
    rows += [(9000 + i, "hot copy " * 30, "web") for i in range(n)] + [rows[0]] * 3
    return rows + [(None, "hot copy " * 30, "web"), (None, None, None), (-5, "y" * 200_000, "long")]


@pytest.mark.parametrize("held", [32 << 20, 20_000])
def test_audit_equals_a_plain_version(spark, monkeypatch, held):
    rng = random.Random(held)
    rows = corpus(rng, 60)
    labels = [(rng.choice([None, *range(130)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    monkeypatch.setattr(op, "HELD", held)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, part string").repartition(5)
    got = op.audit(docs, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, source string"))
    assert got.columns == [c.split()[0] for c in op.SCHEMA.split(", ")]
    found = got.collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == plain(rows, labels) and len(found) == 600 * len({r[2] or "" for r in rows})


def test_equal_hashes_of_unlike_texts_are_kept_apart():
    rows = [(4, 7, b"one", "p"), (2, 7, b"two", "p"), (3, 7, b"one", "q"), (9, 7, b"two", "p"), (3, 7, b"one", "q"), (None, 7, b"one", "p")]
    check_chains(rows, list(op._seen(rows[:3])) + list(op._seen(rows[3:])), 4)  # one of each text and task
    check_chains(rows, list(op._seen(rows, 1)), 5)  # each handed on at once, but for the null id


def check_chains(rows, seen, handed):
    assert sum(not isinstance(x, tuple) for _, x in seen) == handed
    found = Counter()
    for doc_id, part, mask, n in op._chained(seen):
        found[doc_id, part, mask >> 4] += n
    assert found == {(3, "q", 0): 2, (4, "p", 1): 1, (2, "p", 0): 1, (9, "p", 1): 1, (None, "p", 0): 1}


def test_tasks_hand_on_one_record_of_a_hot_text():
    out = list(op._seen((i, 11, b"hot " * 100, "web") for i in range(1000)))
    assert sum(not isinstance(x, tuple) for _, x in out) == 1 and len({c % 8 for c, x in out if isinstance(x, tuple)}) == 8


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.audit(docs, labels).collect() == []
    assert {r["good_lost"] for r in op.audit(spark.createDataFrame([(1, "a", "s")], docs.schema), labels).collect()} == {0}
