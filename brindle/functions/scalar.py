"""Scalar, date, JSON and array functions, and vectorised user functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import register, table
from . import frames
from .partial import GeometricMean, MiddleMagnitude, aggregate


@F.pandas_udf(DoubleType())
def discounted(price: pd.Series, size: pd.Series) -> pd.Series:
    """A user function over Arrow batches; a built-in expression would be faster and is preferred where there is one."""
    return (price * (1 - size / 1000)).round(4)


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("md5"), F.lower(F.substring("text", 1, 12)).alias("head"),
        F.size(F.split("text", " ")).cast("bigint").alias("parts"), F.regexp_extract("text", "([a-z]+)", 1).alias("word"), F.levenshtein("lang", "source").cast("bigint").alias("apart"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_trunc("day", ts).cast("timestamp_ntz").alias("day"), F.weekofyear(ts).cast("bigint").alias("week"), F.dayofweek(ts).cast("bigint").alias("dow"), F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"),
    )


def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("size"), F.round(norm, 6).alias("norm2"), F.round(F.array_max(v), 6).alias("top"))


def exploded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("lang", F.length("word").cast("bigint").alias("n")).agg(F.count("*").alias("words"))


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", discounted("p_retailprice", "p_size").alias("price"))


def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by_user = kinds.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    often = F.map_filter("m", lambda k, v: v >= 10)
    return by_user.select(
        "user_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"),
        F.size(often).cast("bigint").alias("often"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("events"),
    )


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.round(F.sqrt(p), 6).alias("root"), F.round(F.log(q + 1), 8).alias("log"), F.round(F.pow(q, F.lit(1.5)), 4).alias("power"), F.floor(p / 7).cast("bigint").alias("low"), F.ceil(p / 7).cast("bigint").alias("high"),
        F.pmod(F.col("l_orderkey"), F.lit(7)).cast("bigint").alias("rest"), F.greatest("l_discount", "l_tax").alias("most"), F.round(F.sin("l_tax") + F.atan2("l_tax", "l_quantity"), 8).alias("angle"), F.signum(q - 25).cast("bigint").alias("side"), F.shiftleft(F.col("l_linenumber").cast("bigint"), 3).alias("shifted"),
    )


def variant_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json(F.concat(F.lit('{"p": '), F.col("props"), F.lit(', "tags": ["a", "'), F.col("event_type"), F.lit('"]}')))
    return table(spark, sf_dir, "events").withColumn("v", v).select(
        "event_id", F.variant_get("v", "$.p.k", "bigint").alias("k"), F.variant_get("v", "$.tags[1]", "string").alias("tag"), F.try_variant_get("v", "$.none", "int").alias("none"), F.schema_of_variant("v").like("OBJECT%").alias("is_object"),
    )


def grouped_user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user aggregate with partial states, so a user's events needn't fit into a worker."""
    means = aggregate(table(spark, sf_dir, "events"), ["user_id"], ["value"], GeometricMean(), "g")
    return means.select("user_id", F.round("g", 6).alias("g"))


def typical_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user aggregate whose state is a histogram: the middle magnitude of the lines' prices, by flag and supplier."""
    return aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], ["l_extendedprice"], MiddleMagnitude(), "magnitude")


def grouped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function from a frame of whole groups to rows."""

    def shares(orders: pd.DataFrame) -> pd.DataFrame:
        total = orders.groupby("o_custkey", dropna=False)["o_totalprice"].transform("sum")
        return pd.DataFrame({"o_orderkey": orders["o_orderkey"], "share": (orders["o_totalprice"] / total).round(8)})

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return frames.apply(orders, ["o_custkey"], shares, "o_orderkey long, share double")


class Letters:
    """A table function: the distinct letters of a word with their counts."""

    def eval(self, word: str) -> Iterator[tuple[str, int]]:
        for letter in sorted(set(word)):
            yield letter, word.count(letter)


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("brindle_letters", F.udtf(Letters, returnType="letter string, n int"))
    register(spark, sf_dir, "part")
    return spark.sql("SELECT letter, sum(n) AS n, count(*) AS parts FROM part, LATERAL brindle_letters(p_type) GROUP BY letter")


QUERIES = {f.__name__: f for f in (text_functions, date_functions, json_functions, vector_functions, exploded_words, user_function, map_functions, math_functions, variant_functions, grouped_user_function, typical_magnitudes, grouped_frames, table_function)}
SQL = {
    "text_functions": """
SELECT doc_id, length(text) AS n, md5(text) AS md5, lower(substring(text, 1, 12)) AS head, len(string_split(text, ' ')) AS parts,
  regexp_extract(text, '([a-z]+)', 1) AS word, levenshtein(lang, source) AS apart FROM documents
""",
    "date_functions": """
SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(weekofyear(ts) AS BIGINT) AS week, CAST(dayofweek(ts) + 1 AS BIGINT) AS dow, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events
""",
    "json_functions": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "vector_functions": """
SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2,
  round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM embeddings
""",
    "exploded_words": """
SELECT lang, length(word) AS n, count(*) AS words FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL
""",
    "map_functions": """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, CAST(coalesce(sum(n) FILTER (event_type = 'click'), 0) AS BIGINT) AS clicks,
  count(*) FILTER (n >= 10) AS often, CAST(sum(n) AS BIGINT) AS events
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
""",
    "math_functions": """
SELECT l_orderkey, l_partkey, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity + 1), 8) AS log, round(pow(l_quantity, 1.5), 4) AS power,
  CAST(floor(l_extendedprice / 7) AS BIGINT) AS low, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS high, l_orderkey % 7 AS rest, greatest(l_discount, l_tax) AS most,
  round(sin(l_tax) + atan2(l_tax, l_quantity), 8) AS angle, CAST(sign(l_quantity - 25) AS BIGINT) AS side, CAST(l_linenumber AS BIGINT) << 3 AS shifted FROM lineitem
""",
    "variant_functions": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS tag, CAST(NULL AS INTEGER) AS none, true AS is_object FROM events",
    "grouped_user_function": "SELECT user_id, round(exp(avg(ln(value + 1))), 6) AS g FROM events GROUP BY user_id",
    "typical_magnitudes": """
SELECT l_returnflag, l_suppkey, CAST(quantile_disc(m, 0.5) AS INTEGER) AS magnitude FROM (SELECT *, CAST(floor(log2(l_extendedprice)) + 1 AS INTEGER) AS m FROM lineitem) GROUP BY ALL
""",
    "grouped_frames": "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders",
    "table_function": """
SELECT letter, CAST(sum(n) AS BIGINT) AS n, count(*) AS parts FROM (
  SELECT p_partkey, letter, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, '')) AS letter FROM part) WHERE letter <> '' GROUP BY ALL) GROUP BY letter
""",
    "user_function": "SELECT p_partkey, round(p_retailprice * (1 - p_size / 1000), 4) AS price FROM part",
}
