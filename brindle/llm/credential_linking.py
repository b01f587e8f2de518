"""Secret scans by multipart credential linking, on DataFrame functions only.

Strong forms (assignments to secret names, access keys, long hex) are reported
wherever they occur. Weak parts (identifiers, weak secrets, endpoints) are only
reported where complementary parts lie within SCOPE code points: an identifier
needs a secret, a weak secret an identifier or an endpoint, an endpoint both.

Places come from splitting a text at a pattern and summing the lengths of what
lies between and of the matches. The join of weak parts with complementary ones
is an interval join on buckets of SCOPE code points; each bucket is first reduced
to the first and last place of each role, which decide the question exactly, so
no pairs are made.

The scope is measured from the start of a part to the start of the other.

Defined cases: null texts are empty; a text of any length and number of matches
costs time in proportion to them; rows that repeat give the same spans each; a null
doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_texts, written

SCOPE = 240
CHUNK = 64
VALUE = "[A-Za-z0-9+/_.=-]"
#: kind -> (pattern, group whose length counts, least length), in the order of the report.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(" + VALUE + "+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "identifier": (r"(?<![A-Za-z0-9_])(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}", 0, 0),
    "weak_secret": (r"(?<![A-Za-z0-9_])(?i:pwd|passphrase|pass|auth|credentials?|private_?key)[\"']?\x20*[:=]\x20*[\"']?" + VALUE + "{6,}", 0, 0),
    "endpoint": (r"(?<![A-Za-z0-9_])(?:(?i:https?|jdbc|postgres|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:/_-]{3,})", 0, 0),
}
ROLE = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
RANK = {kind: i for i, kind in enumerate([*BASE, *WEAK])}
SPAN = "array<struct<start: int, rank: int, end: int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Running sums of an array, in chunks of CHUNK: no array that grows by one is copied more than that many times."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))
    grown = lambda xs, first: F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    heads = grown(F.transform(chunks, total), F.lit(0))  # one more than there are chunks
    return F.flatten(F.filter(F.zip_with(chunks, heads, lambda xs, head: F.slice(grown(xs, head), 2, F.size(xs))), lambda xs: xs.isNotNull()))


def spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, end); those whose group is too short are left out."""
    none = F.expr(f"cast(array() as {SPAN})")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))  # one more than there are matches
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    each = F.zip_with(F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("w"), F.length(p).alias("p"))), between, lambda m, b: F.struct(b.alias("b"), m["w"].alias("w"), m["p"].alias("p")))

    def placed(each: Column) -> Column:
        ends = _let(F.transform(each, lambda m: m["b"] + m["w"]), _running)
        found = F.zip_with(each, ends, lambda m, end: F.when(m["p"] >= least, F.struct((end - m["w"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"))))
        return F.filter(found, lambda x: x.isNotNull())

    found = _let(F.filter(each, lambda m: m["w"].isNotNull()), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def told(all_spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in RANK))
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame) -> DataFrame:
    """Of the weak parts (k, h, start, rank, end), those with complementary parts in scope; each once."""
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in RANK)), F.col("rank") + 1)
    parts = parts.withColumn("role", role).withColumn("bucket", F.expr(f"start div {SCOPE}"))
    ends = parts.groupBy("k", "h", "bucket").agg(*(f(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{n}") for r in ("identifier", "secret", "endpoint") for n, f in (("first", F.min), ("last", F.max))))
    weak = parts.where(F.col("rank") >= len(BASE)).select("k", "h", "start", "rank", "end", "role", F.explode(F.expr("array(bucket - 1, bucket, bucket + 1)")).alias("bucket"))
    near = {r: F.coalesce(F.max((F.col(f"{r}_first") <= F.col("start") + SCOPE) & (F.col(f"{r}_last") >= F.col("start") - SCOPE)), F.lit(False)) for r in ("identifier", "secret", "endpoint")}
    met = weak.join(ends, ["k", "h", "bucket"]).groupBy("k", "h", "start", "rank", "end", "role").agg(*(v.alias(r) for r, v in near.items()))
    return met.where("(role = 'identifier' and secret) or (role = 'secret' and (identifier or endpoint)) or (role = 'endpoint' and identifier and secret)")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    text = F.col("text")
    kept = for_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = written(kept.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.xxhash64("doc_id", "text").alias("h"),
        *(spans(text, *BASE[k], RANK[k]).alias(k) for k in BASE), F.concat(*(spans(text, *WEAK[k], RANK[k]) for k in WEAK)).alias("weak"),
    ))
    base = F.concat(*BASE)
    parts = found.where(F.size("weak") > 0).select("k", "h", F.explode(F.concat(base, "weak")).alias("s")).select("k", "h", "s.start", "s.rank", "s.end").distinct()
    added = linked(parts).groupBy("k", "h").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    out = found.join(added, ["k", "h"], "left")
    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(told(base), 256).alias("base_sha256"),
        told(F.concat(base, F.coalesce("added", F.expr(f"cast(array() as {SPAN})")))).alias("spans"),
    )
