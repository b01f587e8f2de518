"""Filters, projections, sorts and joins over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import register, table

QUERIES = {}
SQL = {}


def query(sql: str):
    """Registers a query under its function's name, with its DuckDB SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS band,
  p_type LIKE '%O%' AS has_o, p_brand
FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND p_retailprice BETWEEN 900 AND 1500
""")
def projected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD") & F.col("p_retailprice").between(900, 1500))
    band = F.when(F.col("p_size") < 15, "small").when(F.col("p_size") < 35, "medium").otherwise("large")
    return part.select("p_partkey", band.alias("band"), F.col("p_type").like("%O%").alias("has_o"), "p_brand")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
  JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
WHERE r_name = 'ASIA' GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    # Smallest and most selective first; the fact table meets an already filtered set of orders.
    nation = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "n_name")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    local = lines.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return local.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def lines_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted before the join: the join then meets one row an order.
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("""
SELECT coalesce(n, m) AS nation, customers, suppliers FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
FULL OUTER JOIN (SELECT s_nationkey AS m, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n = m
""")
def nation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@query("SELECT o_orderkey, l_linenumber FROM (SELECT * FROM lineitem WHERE l_quantity > 49) RIGHT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def orders_with_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "right").select("o_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)")
def orders_with_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.09")
    return table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


def not_in(left: DataFrame, key: str, right: DataFrame, listed: str) -> DataFrame:
    """The rows of left for which `key NOT IN (SELECT listed FROM right)` is true: none if the list holds a null, and none
    with a null key unless the list is empty. A null-aware anti join would have to broadcast the whole list; this takes a
    plain anti join and two counts of the list."""
    facts = right.agg(F.count("*").alias("n"), F.count_if(F.col(listed).isNull()).alias("nulls"))
    apart = left.join(right.select(F.col(listed).alias("__listed")), F.col(key) == F.col("__listed"), "left_anti")
    return apart.where((facts.select("nulls").scalar() == 0) & (F.col(key).isNotNull() | (facts.select("n").scalar() == 0)))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_in(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)")
def orders_of_small_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    return table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT CASE WHEN l_quantity < 49 THEN l_orderkey END FROM lineitem)")
def not_in_a_list_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row at all: the list holds nulls."""
    listed = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") < 49, F.col("l_orderkey")).alias("k"))
    return not_in(table(spark, sf_dir, "orders"), "o_orderkey", listed, "k").select("o_orderkey")


#: Parts that the rows of one brand and size are dealt to.
STRIPES = 8

BANDS = [("debt", -1000.0, 0.0), ("low", 0.0, 3000.0), ("high", 3000.0, 10000.0), ("top", 9000.0, 10000.0)]


@query("""
SELECT c_custkey, band FROM customer JOIN (VALUES ('debt', -1000, 0), ('low', 0, 3000), ('high', 3000, 10000), ('top', 9000, 10000)) AS b(band, low, high)
  ON c_acctbal >= low AND c_acctbal < high
""")
def balance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theta join without any equality; its other side is the literal table of bands, and so has a known size."""
    bands = spark.createDataFrame(BANDS, "band string, low double, high double")
    return table(spark, sf_dir, "customer").join(F.broadcast(bands), F.expr("c_acctbal >= low and c_acctbal < high")).select("c_custkey", "band")


@query("""
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem o
WHERE l_quantity < (SELECT 0.3 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = o.l_partkey)
""")
def small_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    usual = lines.groupBy("l_partkey").agg((0.3 * F.avg("l_quantity")).alias("least"))
    return lines.join(usual, "l_partkey").where("l_quantity < least").select("l_orderkey", "l_partkey", "l_quantity")


@query("""
SELECT a.p_partkey AS cheap, b.p_partkey AS dear FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_retailprice < b.p_retailprice
""")
def dearer_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs grow with the square of a brand and size, and make up all of the work. So they are dealt to all tasks: by
    brand, size and a stripe of the cheaper part, with a copy of the dearer part for each stripe."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    cheap = part.withColumn("stripe", F.pmod(F.xxhash64("p_partkey"), F.lit(STRIPES)))
    dear = part.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(STRIPES - 1).cast("bigint"))))
    keys = ["p_brand", "p_size", "stripe"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    a, b = cheap.repartition(tasks, *keys).alias("a"), dear.repartition(tasks, *keys).alias("b").hint("merge")
    same = F.expr("a.p_brand = b.p_brand and a.p_size = b.p_size and a.stripe = b.stripe and a.p_retailprice < b.p_retailprice")
    return a.join(b, same).select(F.col("a.p_partkey").alias("cheap"), F.col("b.p_partkey").alias("dear"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def regions_by_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross join of two dimension tables."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query("SELECT r_name, band FROM region CROSS JOIN (SELECT unnest(['low', 'mid', 'high']) AS band)")
def region_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name", F.explode(F.array(F.lit("low"), F.lit("mid"), F.lit("high"))).alias("band"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT c_mktsegment, count(*) AS n FROM s JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) > 10
""")
def finished_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through SQL text over registered views."""
    register(spark, sf_dir, "orders", "customer")
    return spark.sql("""
        WITH s AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
        SELECT c_mktsegment, count(*) AS n FROM s JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) > 10""")
