"""Relational queries over the star tables: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.retrieval import top_per_key
from lodestar.sources.tables import read


def _net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices of the lines shipped up to a day, by flag and status."""
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum(_net()), 2).alias("net"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.count("*").alias("n"),
    )


PRICING_SUMMARY = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""


def tenant_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of each owner (nation) by its accounts (customers) against a quota."""
    used = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("used"))
    accounts = read(spark, sf_dir, "customer").join(used, "c_custkey", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    per = accounts.groupBy("c_nationkey").agg(F.sum("used").alias("used"), F.count("*").alias("accounts"))
    named = per.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "accounts", "used", (F.col("used") >= 500).alias("denied"))


TENANT_QUOTA = """WITH u AS (SELECT o_custkey, count(*) AS used FROM orders GROUP BY 1)
SELECT n_name, count(*) AS accounts, coalesce(sum(used), 0)::BIGINT AS used, coalesce(sum(used), 0) >= 500 AS denied
FROM customer LEFT JOIN u ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"""


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net revenue by region and nation of the supplier, where customer and supplier share the nation."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, "o_custkey").where("c_nationkey = s_nationkey")
    return rows.join(places, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.round(F.sum(_net()), 2).alias("revenue"))


REGION_REVENUE = """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"""


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their totals over all groupings of status and priority."""
    rows = read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("grouping"))


ORDER_CUBE = """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
GROUPING(o_orderstatus, o_orderpriority) AS grouping FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""


def part_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and total price by brand and size, with subtotals."""
    return read(spark, sf_dir, "part").rollup("p_brand", "p_size").agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price")
    ).select(F.coalesce("p_brand", F.lit("all")).alias("p_brand"), F.coalesce("p_size", F.lit(-1)).alias("p_size"), "n", "price")


PART_ROLLUP = "SELECT coalesce(p_brand, 'all') AS p_brand, coalesce(p_size, -1) AS p_size, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY ROLLUP (p_brand, p_size)"


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest orders of every customer."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_key(rows, "o_custkey", 2, F.desc("o_totalprice"), F.col("o_orderkey"))


TOP_ORDERS = """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT * FROM r WHERE rank <= 2"""


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total and gap in days of each customer's orders."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey",
        F.round(F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.coalesce(F.date_diff("o_orderdate", F.lag("o_orderdate").over(order)), F.lit(-1)).cast("long").alias("gap"),
    )


RUNNING_TOTAL = """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
coalesce(date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate), -1) AS gap FROM orders"""


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order, by segment."""
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


IDLE_CUSTOMERS = "SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1"


def nation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers in debt and with suppliers in debt: in both, or in one only."""
    c = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    s = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    parts = (("both", c.intersect(s)), ("customers", c.subtract(s)), ("suppliers", s.subtract(c)))
    out = [df.select("nation", F.lit(name).alias("side")) for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


NATION_SETS = """WITH c AS (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0), s AS (SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal < 0)
SELECT nation, 'both' AS side FROM (SELECT * FROM c INTERSECT SELECT * FROM s) UNION ALL
SELECT nation, 'customers' FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT nation, 'suppliers' FROM (SELECT * FROM s EXCEPT SELECT * FROM c)"""


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority by status, a column a status."""
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return rows.select("o_orderpriority", *(F.coalesce(s, F.lit(0)).alias(f"status_{s.lower()}") for s in "FOP"))


STATUS_PIVOT = """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o,
count(*) FILTER (o_orderstatus = 'P') AS status_p FROM orders GROUP BY 1"""


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join of parts with price bands, by band: the band is computed, so it is no nested loop."""
    band = F.floor(F.col("p_retailprice") / 25)
    return read(spark, sf_dir, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


PRICE_BANDS = "SELECT floor(p_retailprice / 25)::BIGINT AS band, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1"

NAMES = (
    "pricing_summary tenant_quota region_revenue order_cube part_rollup top_orders running_total idle_customers nation_sets status_pivot price_bands"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
