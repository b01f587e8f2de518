"""Grouping sets, distinct and statistical aggregates, pivots, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES = {}
SQL = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


def _grouped(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        return getattr(lines, name)("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))

    run.__name__ = f"lines_{name}"
    return run


for _name in ("rollup", "cube"):
    query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY {_name}(l_returnflag, l_linestatus)")(_grouped(_name))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def lines_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase
FROM events GROUP BY user_id
""")
def events_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return wide.select("user_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


@query("SELECT s_suppkey, 'balance' AS field, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def supplier_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "field", "amount")


@query("""
SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS var, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS med,
  min(value) AS low, max(value) AS high FROM events GROUP BY 1
""")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"), F.round(F.expr("percentile_cont(0.5) within group (order by value)"), 6).alias("med"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_pop(l_quantity, l_discount), 8) AS c FROM lineitem GROUP BY 1")
def line_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.round(F.covar_pop("l_quantity", "l_discount"), 8).alias("c"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT o_custkey, max_by(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS best, bool_or(o_orderstatus = 'P') AS has_p FROM orders GROUP BY 1")
def best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_p"))


def approximate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: no SQL twin, tested against exact values within their error."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 10_000).alias("med"))


QUERIES["approximate_users"] = approximate_users


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


def _set_query(name: str, words: str, apply, below: int = 25) -> None:
    """below: only suppliers of nations with smaller keys, so that a difference has rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customers, suppliers = _keys(spark, sf_dir)
        return apply(customers, suppliers.where(F.col("k") < below))

    run.__name__ = name
    query(f"SELECT c_nationkey AS k FROM customer {words} SELECT s_nationkey FROM supplier WHERE s_nationkey < {below}")(run)


_set_query("set_union", "UNION", lambda a, b: a.union(b).distinct())
_set_query("set_union_all", "UNION ALL", lambda a, b: a.union(b))
_set_query("set_intersect", "INTERSECT", lambda a, b: a.intersect(b))
_set_query("set_intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
_set_query("set_except", "EXCEPT", lambda a, b: a.subtract(b), 12)
_set_query("set_except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b), 12)
