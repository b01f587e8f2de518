"""Importance resampling towards a target: draws the documents whose words are likelier in a target text.

Features are runs of 1 to `RUN` consecutive words, hashed (crc32) to `BUCKETS` buckets. Higher-order functions make each
document's array of buckets; a bucket's gain is the logarithm of its share in the target over its share in the
documents, and a document's weight the mean gain of its features, an aggregate over `element_at` of one literal array.
Nothing is exploded to score; only the counts of buckets are summed across partitions, at most `BUCKETS` rows a task.
Gumbel noise from a hash of the id makes the highest scores a draw without replacement.

The cut is found from the counts of each score, which are whole numbers between about -50,000 and 70,000 (logarithms
of counts below 2^64, and of a 32-bit hash), so the table of counts that the driver reads has that bound. Only rows
at or above it are sorted, by ranges, and numbered: no task holds all of them.

Defined cases: null or empty text, or a text without words, has no features, weight 0 and never takes part in the draw;
texts with fewer than `LEAST` words get a score but no rank. A null id counts as an empty text in the hash and comes last
among ties. Rows that repeat are each a document; rows of one id and score are ranked by n_features, then weight. An
empty target makes every gain that of a share of 1 in BUCKETS. An empty table gives no rows. Texts of any length are
one array of ints each. Other columns of the input are ignored by `ranked` and passed through by
`drawn`, whose own columns begin with `__brindle_`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import discard, for_texts, written

RUN = 1
BUCKETS = 10_000
LEAST = 20
PERCENT = 10
SEED = 2024

#: What own columns beside a caller's begin with.
OWN = "__brindle_"

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands between words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, in a text whose A-Z aren't lower-cased yet.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words; most have no upper case, and `lower` shows that faster than `translate` does."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")
    return F.transform(found, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, SMALL)))


def runs(found: Column, most: int) -> Column:
    """All runs of 1 to most consecutive words, joined by a space; repeats stay. Words are taken one by one, as a slice
    would copy the whole array for every run."""

    def joined(m: int) -> Column:
        starts = F.when(F.size(found) >= m, F.sequence(F.lit(0), F.size(found) - m)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(found, i + j) for j in range(m))))

    return F.concat(found, *(joined(m) for m in range(2, most + 1)))


def buckets(features: Column, most: int = BUCKETS) -> Column:
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % most).cast("int"))


def _hashed(texts: DataFrame, run: int, most: int) -> DataFrame:
    """texts with n_words and the array of buckets, in columns that begin with OWN."""
    found = texts.withColumn(f"{OWN}words", words(F.col("text")))
    return found.withColumns({f"{OWN}n_words": F.size(f"{OWN}words").cast("bigint"), f"{OWN}buckets": buckets(runs(F.col(f"{OWN}words"), run), most)}).drop(f"{OWN}words")


def _counts(hashed: DataFrame, most: int) -> list[int]:
    """Features of all texts by bucket."""
    out = [0] * most
    for r in hashed.select(F.explode(f"{OWN}buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of each bucket's share in the target over that in the documents, both with one added count."""
    most, all_raw, all_target = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_raw + most) / (float(s + 1) * float(all_target + most)))) for s, t in zip(raw, target)]


def _noise(seed: int) -> Column:
    """floor of 1000 times a Gumbel variable that the id alone decides."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _scored(hashed: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """hashed with the number of features, weight and score."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(f"{OWN}buckets", F.lit(0).cast("bigint"), lambda a, x: a + F.element_at(literal, x + 1))
    found = hashed.withColumns({f"{OWN}n_features": F.size(f"{OWN}buckets").cast("bigint"), f"{OWN}total": total})
    least = f"greatest({OWN}n_features, 1)"
    found = found.withColumn(f"{OWN}weight", F.expr(f"({OWN}total - pmod({OWN}total, {least})) div {least}"))
    return found.withColumns({f"{OWN}score": F.col(f"{OWN}weight") + _noise(seed), f"{OWN}missing": F.col("doc_id").isNull()})


def _cut(found: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many of found are drawn, and the lowest score among them (None: none is)."""
    per_score = found.groupBy("score").agg(F.count("*").alias("n")).collect()
    drawn, above = percent * sum(r["n"] for r in per_score) // 100, 0
    for r in sorted(per_score, key=lambda r: -r["score"]):
        above += r["n"]
        if above >= drawn > 0:
            return drawn, r["score"]
    return 0, None


#: Highest scores first, and what settles ties.
ORDER = ["-score", "missing", "doc_id", "n_features", "weight"]


def _all(documents: DataFrame, benchmark: DataFrame, run: int, most: int, seed: int) -> tuple[list[int], DataFrame]:
    """The gains, and a table of every document's numbers. Texts are read once: the arrays of buckets, about two bytes a
    word, are written, counted and then scored."""
    hashed = written(_hashed(for_texts(documents.select("doc_id", "text")), run, most).drop("text"))
    gain = gains(_counts(hashed, most), _counts(_hashed(benchmark.select("text"), run, most), most))
    own = ("n_words", "n_features", "weight", "score", "missing")
    found = written(_scored(hashed, gain, seed).select("doc_id", *(F.col(f"{OWN}{c}").alias(c) for c in own)))
    discard(hashed)
    return gain, found


def ranked(documents: DataFrame, benchmark: DataFrame, run: int = RUN, most: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    _, found = _all(documents, benchmark, run, most, seed)
    able = F.col("n_words") >= least
    n, cut = _cut(found.where(able), percent)
    columns, none = ["doc_id", "n_features", "weight", "score"], F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return found.select(*columns, none)
    high = able & (F.col("score") >= cut)
    order = numbered(found.where(high), ORDER, "place")
    return order.select(*columns, F.when(F.col("place") <= n, F.col("place")).alias("rank")).unionByName(found.where(~high).select(*columns, none))


def drawn(documents: DataFrame, benchmark: DataFrame, run: int = RUN, most: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn documents with all their columns, texts included. They are scored once more and held against the last
    one drawn, so no text is shuffled; rows that tie with it in everything all stay."""
    gain, found = _all(documents, benchmark, run, most, seed)
    able = F.col("n_words") >= least
    n, cut = _cut(found.where(able), percent)
    if cut is None:
        return documents.limit(0)
    last = numbered(found.where(able & (F.col("score") >= cut)), ORDER, "place").where(F.col("place") == n).first()
    place = lambda of: F.struct(-of("score"), of("missing"), of("doc_id"), of("n_features"), of("weight"))
    scored = _scored(_hashed(documents, run, most), gain, seed)
    kinds = dict(found.dtypes)
    upto = place(lambda c: F.lit(last[c]).cast(kinds[c])) >= place(lambda c: F.col(c if c == "doc_id" else f"{OWN}{c}"))
    return scored.where((F.col(f"{OWN}n_words") >= least) & upto).select(*documents.columns)
