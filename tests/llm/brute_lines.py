"""Line dedup by its definition, one document after another."""

from __future__ import annotations

import re
import struct

import xxhash


def _h(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pair(a: int, b: int) -> int:
    return _signed(_h(struct.pack("<q", b), _h(struct.pack("<q", a))))


def brute(rows: list[tuple], gram_words: int, run_words: int) -> dict:
    """(doc_id, text) rows of distinct ids -> deleted line places by doc_id."""
    docs = {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n") if t is not None else []
        z = [(p, line, len(re.findall(r"[^ \t\n\x0b\f\r]+", line))) for p, line in enumerate(lines)]
        docs[i] = [y for y in z if y[2]]
    prints = {}
    for i, z in docs.items():
        grams = []
        for a in range(len(z)):
            n, g, e = 0, 42, a
            while e < len(z) and n < gram_words:
                g, n, e = _pair(g, _signed(_h(z[e][1].encode()))), n + z[e][2], e + 1
            grams.append((g, e, n))
        found = set()
        for a in range(len(z)):
            n, e = 0, a
            while e < len(z) and n < run_words:
                n, e = n + z[e][2], e + 1
            if n >= run_words:
                found.add(min((grams[b][0], -b) for b in range(a, e) if grams[b][1] <= e and grams[b][2] >= gram_words))
        prints[i] = sorted((g, -b) for g, b in found)
    first = {}
    for i in sorted(docs):
        for g, b in prints[i]:
            first.setdefault(g, (i, b))
    gone = {i: set() for i in docs}
    for i in docs:
        faced = set()
        before = {}
        for g, b in prints[i]:
            if g in before:
                faced.add((i, b - before[g]))
            elif first[g][0] != i:
                faced.add((first[g][0], b - first[g][1]))
            before[g] = b
        for j, d in faced:
            run = []
            for a in range(len(docs[i]) + 1):
                if a < len(docs[i]) and 0 <= a - d < len(docs[j]) and docs[i][a][1] == docs[j][a - d][1]:
                    run.append(a)
                    continue
                if sum(docs[i][b][2] for b in run) >= gram_words:
                    gone[i].update(range(docs[i][run[0]][0], docs[i][run[-1]][0] + 1))
                run = []
    return gone
