"""Decision-support queries over the star schema, adapted to the columns at hand, and web-log analytics.

Money is summed as decimals, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators.joins import broadcast_join, hash_join
from sparkloom.operators.sizes import fits_broadcast
from sparkloom.plans.q_sql import sql_query
from sparkloom.plans.registry import query
from sparkloom.sources.files import scratch, write_bucketed
from sparkloom.tables import table

_NET = "CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))"


def _dbl(x: str, name: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE) AS {name}"


sql_query(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, {_dbl('sum(CAST(l_quantity AS DECIMAL(18,4)))', 'sum_qty')}, {_dbl('sum(CAST(l_extendedprice AS DECIMAL(18,4)))', 'sum_base_price')},
        {_dbl(f'sum({_NET})', 'sum_disc_price')}, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    tables="lineitem",
)
sql_query(
    "tpch_q3",
    f"""SELECT l_orderkey, {_dbl(f'sum({_NET})', 'revenue')}, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY sum({_NET}) DESC, l_orderkey LIMIT 10""",
    tables="customer orders lineitem",
)
sql_query(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
       AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
    tables="orders lineitem",
)
sql_query(
    "tpch_q5",
    f"""SELECT n_name, {_dbl(f'sum({_NET})', 'revenue')} FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
        AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name""",
    tables="customer orders lineitem supplier nation region",
)
sql_query(
    "tpch_q6",
    f"""SELECT {_dbl('sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4)))', 'revenue')} FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    tables="lineitem",
)
sql_query(
    "tpch_q7",
    f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {_dbl(f'sum({_NET})', 'revenue')}
        FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey
        AND c_nationkey = n2.n_nationkey AND ((n1.n_regionkey = 2 AND n2.n_regionkey = 3) OR (n1.n_regionkey = 3 AND n2.n_regionkey = 2)) GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""",
    tables="supplier lineitem orders customer nation",
)
sql_query(
    "tpch_q8",
    f"""SELECT CAST(year(o_orderdate) AS INT) AS o_year, round(CAST(sum(CASE WHEN n2.n_name = 'NATION_3' THEN {_NET} ELSE 0 END) AS DOUBLE) / CAST(sum({_NET}) AS DOUBLE), 6) AS mkt_share
        FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
        AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey GROUP BY year(o_orderdate)""",
    tables="part supplier lineitem orders customer nation region",
)
sql_query(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, {_dbl(f'sum({_NET})', 'revenue')}, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R'
        AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY sum({_NET}) DESC, c_custkey LIMIT 20""",
    tables="customer orders lineitem nation",
)
sql_query(
    "tpch_q11",
    """SELECT s_nationkey, p_brand, CAST(sum(l_quantity) AS DOUBLE) AS stock FROM lineitem, supplier, part WHERE l_suppkey = s_suppkey AND l_partkey = p_partkey GROUP BY s_nationkey, p_brand
       HAVING sum(l_quantity) > (SELECT sum(l_quantity) * 0.002 FROM lineitem)""",
    tables="lineitem supplier part",
)
sql_query(
    "tpch_q12",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey
       AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_linestatus""",
    tables="orders lineitem",
)
sql_query(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) c_orders GROUP BY c_count""",
    tables="customer orders",
)
sql_query(
    "tpch_q14",
    f"""SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_NET} ELSE 0 END) AS DOUBLE) / CAST(sum({_NET}) AS DOUBLE), 6) AS promo_revenue FROM lineitem, part
        WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-10-01 00:00:00'""",
    tables="lineitem part",
)
sql_query(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({_NET}) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, {_dbl('total_revenue', 'total_revenue')} FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    tables="supplier lineitem",
)
sql_query(
    "tpch_q17",
    """SELECT CAST(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / 7.0, 2) AS DOUBLE) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3'
       AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    tables="lineitem part",
)
sql_query(
    "tpch_q18",
    f"""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {_dbl('sum(CAST(l_quantity AS DECIMAL(18,4)))', 'sum_qty')} FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE), o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    tables="customer orders lineitem",
)
sql_query(
    "tpch_q19",
    f"""SELECT {_dbl(f'sum({_NET})', 'revenue')} FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
        OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
    tables="lineitem part",
)
sql_query(
    "tpch_q20",
    """SELECT s_name, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%a%'
       AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_suppkey HAVING sum(l_quantity) > 100)""",
    tables="supplier lineitem part",
)
sql_query(
    "tpch_q22",
    f"""SELECT c_nationkey AS cntrycode, count(*) AS numcust, {_dbl('sum(CAST(c_acctbal AS DECIMAL(18,4)))', 'totacctbal')} FROM customer WHERE c_nationkey IN (3, 7, 11, 13, 17, 19, 23)
        AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY c_nationkey""",
    tables="customer orders",
)
for _share in (0, 50, 100):
    sql_query(
        f"tpch_q6_selectivity_{_share}",
        f"SELECT {_dbl('coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4))), 0)', 'revenue')} FROM lineitem WHERE l_quantity <= {_share / 2}",
        tables="lineitem",
    )


# parts of suppliers are those of their lines, with the least price as the cost
_PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"
sql_query(
    "tpch_q2",
    f"""WITH ps AS {_PARTSUPP}, e AS (SELECT ps_partkey, ps_supplycost, s_acctbal, s_name, n_name FROM ps, supplier, nation, region
         WHERE s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, e WHERE p_partkey = ps_partkey AND p_size <= 15 AND p_type LIKE '%A%'
        AND ps_supplycost = (SELECT min(x.ps_supplycost) FROM e x WHERE x.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    tables="lineitem part supplier nation region",
)
sql_query(
    "tpch_q9",
    f"""WITH ps AS {_PARTSUPP} SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year,
        CAST(round(sum({_NET}), 2) AS DOUBLE) - CAST(round(sum(ps_supplycost * CAST(l_quantity AS DECIMAL(12,2))), 2) AS DOUBLE) / 100 AS sum_profit FROM part, supplier, lineitem, ps, orders, nation
        WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%a%'
        GROUP BY n_name, CAST(year(o_orderdate) AS INT)""",
    tables="part supplier lineitem orders nation",
)
sql_query(
    "tpch_q16",
    f"""WITH ps AS {_PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#11' AND p_type NOT LIKE 'PROMO%'
        AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    tables="lineitem part supplier",
)
sql_query(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY
       AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
       AND NOT EXISTS (SELECT 1 FROM lineitem l3, orders o3 WHERE o3.o_orderkey = l3.l_orderkey AND l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o3.o_orderdate + INTERVAL '60' DAY)
       AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    tables="supplier lineitem orders nation",
)

_Q3 = f"""SELECT l_orderkey, {_dbl(f'sum({_NET})', 'revenue')}, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
    GROUP BY l_orderkey, CAST(o_orderdate AS DATE)"""


def _q3(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, join) -> DataFrame:
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    c = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = orders.where(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    l = lineitem.where(F.col("l_shipdate") > day).select(F.col("l_orderkey").alias("o_orderkey"), F.expr(_NET).alias("net"))
    joined = join(l, join(o, c, ["o_custkey"]), ["o_orderkey"])
    return joined.groupBy(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").agg(F.round(F.sum("net"), 2).cast("double").alias("revenue"))


def _q3_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("customer", "orders", "lineitem")]


@query("tpch_q3_barrier", _Q3)
def tpch_q3_barrier(spark: SparkSession, d: str) -> DataFrame:
    """Both joins after a shuffle of both sides."""
    return _q3(*_q3_tables(spark, d), hash_join)


@query("tpch_q3_pipelined", _Q3)
def tpch_q3_pipelined(spark: SparkSession, d: str) -> DataFrame:
    """Sides that fit are broadcast, so lines stream through both joins without a shuffle before the aggregate."""
    return _q3(*_q3_tables(spark, d), lambda l, r, keys: broadcast_join(l, r, keys))


@query("tpch_q3_partitioned", _Q3)
def tpch_q3_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Orders and lines are stored in buckets of the order's key: their join and the aggregate need no shuffle."""
    customer, orders, lineitem = _q3_tables(spark, d)
    at, names = scratch(spark), {}
    for name, df, key in (("orders", orders, "o_orderkey"), ("lineitem", lineitem, "l_orderkey")):
        names[name] = f"partitioned_{name}_{at[-12:]}"
        write_bucketed(df, names[name], [key], 16, f"{at}/{name}")
    return _q3(customer, spark.table(names["orders"]), spark.table(names["lineitem"]), lambda l, r, keys: broadcast_join(l, r, keys) if keys == ["o_custkey"] else l.join(r.hint("merge"), keys))


@query(
    "tpch_q5_bushy",
    f"""SELECT n_name, {_dbl(f'sum({_NET})', 'revenue')} FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
        AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
)
def tpch_q5_bushy(spark: SparkSession, d: str) -> DataFrame:
    """The same joins as a bushy plan: suppliers of the region against orders of customers."""
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    s = F.broadcast(s) if fits_broadcast(s) else s
    co = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    ls = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey", "n_name", F.expr(_NET).alias("net"))
    joined = ls.join(co, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return joined.groupBy("n_name").agg(F.round(F.sum("net"), 2).cast("double").alias("revenue"))


# web-log analytics; events stand for visits, documents for pages

sql_query("amplab_q1", "SELECT event_id, value FROM events WHERE value > 90", tables="events")
sql_query("amplab_q2", "SELECT substring(c_name, 1, 17) AS prefix, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS total FROM customer GROUP BY substring(c_name, 1, 17)", tables="customer")


@query(
    "amplab_q3",
    """WITH v AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue, avg(c_nationkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey)
       SELECT o_custkey, revenue, rank FROM v ORDER BY revenue DESC, o_custkey LIMIT 1""",
)
def amplab_q3(spark: SparkSession, d: str) -> DataFrame:
    """Join, sums per visitor, and the visitor with the most, by one aggregate instead of a sort."""
    visits = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    joined = visits.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    each = joined.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("revenue"), F.avg("c_nationkey").alias("rank"))
    best = each.agg(F.max_by(F.struct("o_custkey", "revenue", "rank"), F.struct("revenue", -F.col("o_custkey"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


@query(
    "amplab_q4",
    r"""SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:node|peer|switch|worker)-[0-9]+')) AS target FROM documents WHERE text IS NOT NULL) GROUP BY target""",
)
def amplab_q4(spark: SparkSession, d: str) -> DataFrame:
    """Links out of texts by pattern, counted per target."""
    links = F.regexp_extract_all("text", F.lit(r"(?:node|peer|switch|worker)-[0-9]+"), F.lit(0))
    return table(spark, d, "documents").select(F.explode(links).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
