"""Line dedup by winnowing over line hashes, on DataFrame functions only.

Lines with words are hashed. A gram is the shortest run of lines from a line on
that has GRAM_WORDS words or more. From each line on, the grams inside the
shortest run of RUN_WORDS words or more make a window, and the least gram hash of
each window (the rightmost of equals) is a fingerprint. So two texts that share a
run of RUN_WORDS words in whole lines share a fingerprint inside it.

Fingerprints meet their first occurrence in the corpus, by doc_id and then by a
hash of the row, or the occurrence just before them in the same document. That
gives a diagonal of two documents (or of one with itself); along it equal lines
are extended both ways to maximal runs, and every run of GRAM_WORDS words or more
is deleted from the later place.

A run can repeat between two later places while each of its grams was first seen
elsewhere. So the shortest runs of RUN_WORDS words or more, from each line on and
up to each line, meet the first run equal to them as well, and are deleted too.
Between them they cover every run of RUN_WORDS words, so none stays in a second
place, whatever came before. Only runs that hold a fingerprint seen twice are
looked at, as equal runs share one.

Every deleted line has an equal one in an earlier place, so some copy of every
line stays. Blank lines inside a deleted run go with it; those between two
deleted runs stay.

Lines, and the shortest runs, count as equal by 64-bit hashes.

Defined cases: null texts stay null and empty ones empty, without lines; texts of
any length are whole, and cost time in proportion to their lines, once for each distinct
offset at which they face an earlier text (or themselves); lines are split at newlines only; rows that repeat (same doc_id and text) count as one
document and get the same result each; rows of one doc_id with different texts
are different documents; a null doc_id comes first; extra columns are ignored by
`deduplicated` and kept by `without_repeats`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, for_texts, written

GRAM_WORDS, RUN_WORDS = 25, 50


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with own columns __brindle_k (the id as text) and __brindle_h (a hash of the row's id and text)."""
    return docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__brindle_k"), F.xxhash64("doc_id", "text").alias("__brindle_h"))


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a value bound to a name: it is computed once, however often body uses it, lambdas included."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _run(words: int, hashed: bool, most: int, z: str, seed: int) -> str:
    """SQL for the shortest run from each line on with so many words, looking at `most` lines: words n, lines m, hash g."""
    g = ", xxhash64(a.g, y.x) as g" if hashed else ""
    return f"""aggregate(slice({z}, i + 1, {most}), struct(0 as n, 0 as m{f", {seed}L as g" if hashed else ""}),
        (a, y) -> if(a.n >= {words}, a, struct(a.n + y.w as n, a.m + 1 as m{g})))"""


def _runs(words: int, hashed: bool, z: str = "z", seed: int = 42) -> str:
    """SQL for the runs from all lines: most need few lines, and none more lines than words, as each line has a word at least."""
    return f"transform(transform({z}, (y, i) -> {_run(words, hashed, 3, z, seed)}), (r, i) -> if(r.n >= {words} or r.m < 3, r, {_run(words, hashed, words, z, seed)}))"


#: SQL for the number of words of a line l. Where its words have one space between them and none around, spaces tell.
WORDS = r"""if(l = '', 0, if(l rlike '[\t\x0B\f\r]|  |^ | $', regexp_count(l, '[^\\s]+'), length(l) - length(replace(l, ' ', '')) + 1))"""


def _marked(docs: DataFrame) -> DataFrame:
    """k, h, id, z and s of each document once. z: the lines with words as structs of place p (from 0), hash x and words w;
    s: fingerprints (g, i), sorted, where i is the gram's first line in z, from 1."""
    z = f"filter(transform(split(text, '\\n', -1), (l, i) -> struct(i as p, xxhash64(l) as x, {WORDS} as w)), y -> y.w > 0)"
    least = f"""transform(filter(transform({_runs(RUN_WORDS, False)}, (r, i) -> struct(r.n as n, r.m as m, i as i)), r -> r.n >= {RUN_WORDS}),
        r -> array_min(filter(transform(slice(grams, r.i + 1, r.m), (g, j) -> struct(g.g as g, -(r.i + j + 1) as i, j + g.m as e, g.n as n)), g -> g.e <= r.m and g.n >= {GRAM_WORDS})))"""
    prints = _let(_runs(GRAM_WORDS, True), "grams", f"array_sort(array_distinct(transform({least}, y -> struct(y.g as g, -y.i as i))))")
    both = F.expr(_let(z, "z", f"struct(z as z, {prints} as s)"))
    rows = docs.where("text is not null").select(F.col("__brindle_k").alias("k"), F.col("__brindle_h").alias("h"), F.col("doc_id").alias("id"), both.alias("b"))
    return rows.groupBy("k", "h").agg(F.first("id").alias("id"), F.first("b").alias("b")).select("k", "h", "id", "b.z", "b.s").where("size(z) > 0")


def _met(marked: DataFrame) -> DataFrame:
    """k, h, i and lead (whether it is the document's first of its hash) of the fingerprints seen twice or more, with
    their first occurrence k2, h2, i2 and the number n of documents, as a table."""
    prints = marked.select("k", "h", "id", F.explode(F.expr("transform(s, (y, j) -> struct(y.g as g, y.i as i, j = 0 or get(s, j - 1).g <> y.g as lead))")).alias("y"))
    prints = prints.select("k", "h", "id", "y.g", "y.i", "y.lead")
    first = prints.groupBy("g").agg(F.min(F.struct("id", "h", "k", "i")).alias("f"), F.count_if("lead").alias("n"), F.count("*").alias("all")).where("all > 1")
    first = written(first.select("g", F.col("f.h").alias("h2"), F.col("f.k").alias("k2"), F.col("f.i").alias("i2"), "n"))
    out = written(prints.join(first, "g").select("k", "h", "i", "lead", "k2", "h2", "i2", "n"))
    discard(first)
    return out


def _diagonals(marked: DataFrame, met: DataFrame) -> DataFrame:
    """k, h (the later document), k2, h2 (the earlier one, or itself) and d: line i of the one faces line i - d of the other."""
    same = "transform(filter(transform(s, (y, j) -> struct(y.g as g, y.i as i, get(s, j - 1) as b)), y -> y.b.g = y.g), y -> y.i - y.b.i)"
    own = marked.select("k", "h", F.explode(F.expr(f"array_distinct({same})")).alias("d")).select("k", "h", F.col("k").alias("k2"), F.col("h").alias("h2"), "d")
    across = met.where("lead and n > 1 and (k <> k2 or h <> h2)").select("k", "h", "k2", "h2", F.expr("i - i2").alias("d"))
    return own.unionByName(across).distinct()


def _repeated(marked: DataFrame, met: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """k, h and r: the range of line places of each shortest run, from a line on or up to one, that occurred before; and
    the scratch tables that it reads."""
    seen = met.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.expr("i - 1"))).alias("q"))
    runs = marked.select("k", "h", "id", "z").join(seen, ["k", "h"])
    # Runs up to a line that are also the shortest from their first line on are there already.
    every = f"""concat(
        transform(filter(transform(on, (r, i) -> struct(r as r, i as a)), y -> y.r.n >= {RUN_WORDS}), y -> struct(y.r.g as g, y.a as a, y.a + y.r.m - 1 as b)),
        transform(filter(transform(up, (r, i) -> struct(r as r, size(z) - i - r.m as a)), y -> y.r.n >= {RUN_WORDS} and get(on, y.a).m <> y.r.m), y -> struct(y.r.g as g, y.a as a, y.a + y.r.m - 1 as b)))"""
    # before[j]: how many of the fingerprints q start above line j, laid out from the gaps between them.
    gap = "if(t = size(q), size(z), q[t]) - if(t = 0, -1, q[t - 1])"
    before = f"flatten(transform(sequence(0, size(q)), t -> array_repeat(t, {gap})))"
    held = f"transform(filter({every}, y -> before[y.b + 1] > before[y.a]), y -> struct(y.g as g, get(z, y.a).p as a, get(z, y.b).p as b))"
    held = _let(before, "before", _let(_runs(RUN_WORDS, True), "on", _let("reverse(z)", "back", _let(_runs(RUN_WORDS, True, "back", 43), "up", held))))
    runs = written(runs.select("k", "h", "id", F.explode(F.expr(held)).alias("y")).select("k", "h", "id", "y.g", "y.a", "y.b"))
    first = runs.groupBy("g").agg(F.min(F.struct("id", "h", "k", "a")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("g", F.col("f.h").alias("h2"), F.col("f.k").alias("k2"), F.col("f.a").alias("a2")))
    return runs.join(first, "g").where("k <> k2 or h <> h2 or a <> a2").select("k", "h", F.array(F.struct("a", "b")).alias("r")), [runs, first]


def _deleted(marked: DataFrame, diagonals: DataFrame, repeated: DataFrame) -> DataFrame:
    """k, h and r: the ranges of line places (from 0, both ends included) to be deleted, merged and sorted."""
    later = marked.select("k", "h", F.expr("transform(z, y -> y.x)").alias("x"), F.expr("transform(z, y -> y.w)").alias("w"), F.expr("transform(z, y -> y.p)").alias("p"))
    earlier = marked.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.expr("transform(z, y -> y.x)").alias("x2"))
    faced = diagonals.join(later, ["k", "h"]).join(earlier, ["k2", "h2"])
    # Along the diagonal: the runs of equal lines between two cuts, which are differing lines or the end.
    end = "least(size(x), size(x2) + d) + 1"
    cuts = f"filter(sequence(greatest(1, 1 + d), {end}), i -> i = {end} or get(x, i - 1) <> get(x2, i - d - 1))"
    between = "transform(cuts, (c, j) -> struct(if(j = 0, greatest(1, 1 + d), cuts[j - 1] + 1) as a, c - 1 as b))"
    long = f"filter({between}, y -> y.b >= y.a and aggregate(slice(w, y.a, y.b - y.a + 1), 0, (n, v) -> n + v) >= {GRAM_WORDS})"
    runs = F.expr(_let(cuts, "cuts", f"transform({long}, y -> struct(get(p, y.a - 1) as a, get(p, y.b - 1) as b))"))
    found = faced.where("least(size(x), size(x2) + d) >= greatest(1, 1 + d)").select("k", "h", runs.alias("r")).where("size(r) > 0")
    whole = found.unionByName(repeated).groupBy("k", "h").agg(F.array_sort(F.flatten(F.collect_set("r"))).alias("r"))
    # With starts and ends sorted each by itself, a merged range begins at a start beyond the end of rank one less, and ends
    # at the end that stands before the next such start.
    heads = "filter(sequence(0, size(r) - 1), j -> j = 0 or r[j].a > ends[j - 1] + 1)"
    merged = "transform(heads, (j, t) -> struct(r[j].a as a, ends[coalesce(get(heads, t + 1), size(r)) - 1] as b))"
    merged = F.expr(_let("array_sort(transform(r, y -> y.b))", "ends", _let(heads, "heads", merged)))
    return whole.select("k", "h", merged.alias("r"))


def _with_text(docs: DataFrame) -> DataFrame:
    """docs with __brindle_text, its text without repeated runs, __brindle_lines and __brindle_removed."""
    keyed = _keyed(for_texts(docs))
    marked = written(_marked(keyed))
    met = _met(marked)
    repeated, scratch = _repeated(marked, met)
    gone = written(_deleted(marked, _diagonals(marked, met), repeated).select(F.col("k").alias("__brindle_k"), F.col("h").alias("__brindle_h"), F.col("r").alias("__brindle_r")))
    discard(marked, met, *scratch)
    # What is deleted grows with the input, so it isn't broadcast where it happens to be small; a partition of it is hashed,
    # and texts need no sort.
    out = keyed.join(gone.hint("shuffle_hash"), ["__brindle_k", "__brindle_h"], "left")
    # Between two deleted ranges, before the first and after the last, lines stay.
    cuts = "concat(array(struct(-1 as a, -1 as b)), __brindle_r, array(struct(size(x) as a, 0 as b)))"
    stay = "flatten(transform(sequence(0, size(c) - 2), k -> slice(x, c[k].b + 2, c[k + 1].a - c[k].b - 1)))"
    kept = F.expr(f"array_join({_let("split(text, '\\n', -1)", 'x', _let(cuts, 'c', stay))}, '\\n')")
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("__brindle_r").isNull(), F.col("text")).otherwise(kept).alias("__brindle_text"),
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.expr("length(text) - length(replace(text, '\\n', '')) + 1")).cast("long").alias("__brindle_lines"),
        F.expr("cast(coalesce(aggregate(__brindle_r, 0, (n, y) -> n + y.b - y.a + 1), 0) as long)").alias("__brindle_removed"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for every row."""
    out = _with_text(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__brindle_lines").alias("n_lines"), F.col("__brindle_removed").alias("n_removed"), F.col("__brindle_text").alias("text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated runs of lines taken out of text (and n_chars, where there is one, to match). A row that
    lost lines and has no word left goes."""
    out = _with_text(docs).where(~((F.col("__brindle_removed") > 0) & ~F.regexp_like("__brindle_text", F.lit(r"[^\s]"))))
    swap = {"text": F.col("__brindle_text"), "n_chars": F.length("__brindle_text").cast("long")}
    return out.select(*(swap[c].alias(c) if c in swap else F.col(f"`{c}`") for c in docs.columns))
