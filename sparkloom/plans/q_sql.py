"""Queries of the SQL surface, as scripts with declarations, and SQL that goes beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.plans.registry import query
from sparkloom.plans.sqlfront import run_script
from sparkloom.tables import register, table

# name -> (declarations, select)
_R, _S, _T, _U = "create table R(a int, b int, c0 int, day date);", "create table S(c int, d int);", "create table T(e int, f int);", "create table U(g int, h int);"
_DATA = """WITH R AS (SELECT n_nationkey AS a, n_regionkey AS b, n_nationkey * 2 AS c0, DATE '2001-01-01' + CAST(n_nationkey - 5 AS INT) AS day FROM nation),
 S AS (SELECT r_regionkey AS c, r_regionkey + 10 AS d FROM region), S2 AS (SELECT r_regionkey AS b, r_regionkey + 20 AS c FROM region),
 T AS (SELECT s_nationkey AS e, CAST(s_suppkey AS INT) AS f FROM supplier), U AS (SELECT CAST(c_custkey AS INT) AS g, c_nationkey AS h FROM customer) """


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return {
        "r": n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), (F.col("n_nationkey") * 2).alias("c0"), F.expr("date_add(DATE'2001-01-01', n_nationkey - 5)").alias("day")),
        "s": r.select(F.col("r_regionkey").alias("c"), (F.col("r_regionkey") + 10).alias("d")),
        "s2": r.select(F.col("r_regionkey").alias("b"), (F.col("r_regionkey") + 20).alias("c")),
        "t": table(spark, d, "supplier").select(F.col("s_nationkey").alias("e"), F.col("s_suppkey").cast("int").alias("f")),
        "u": table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("g"), F.col("c_nationkey").alias("h")),
    }


_SCRIPTS = {
    "sql_product": (_R, "select a * b as v from R"),
    "sql_qualified": (_R, "select R.a * R.b as v from R"),
    "sql_literal": (_R, "select 10 as v, a from R"),
    "sql_literal_only": (_R, "select 1 as one, 'x' as x"),
    "sql_derived": (_R, "select d * c as v from (select a as c, b as d from R) as Y"),
    "sql_derived_qualified": (_R, "select Y.d * Y.c as v from (select a as c, b as d from R) as Y"),
    "sql_sum": (_R, "select cast(sum(a * b) as bigint) as v from R where b > 2"),
    "sql_group": (_R, "select b, cast(sum(a) as bigint) as v from R group by b"),
    "sql_group_where": (_R, "select b, cast(sum(a) as bigint) as v from R where b > 2 group by b"),
    "sql_having": (_R, "select b, cast(sum(a) as bigint) as v from R where b > 0 group by b having sum(a) > 50"),
    "sql_two_sums": (_R, "select b, cast(sum(a) as bigint) as v, cast(sum(a * c0) as bigint) as w from R group by b"),
    "sql_min_max_count": (_R, "select b, min(a) as lo, max(a) as hi, count(*) as n from R group by b"),
    "sql_where": (_R, "select a * b as v from R where b > 2"),
    "sql_where_multi": (_R, "select a * b as v from R where b > 2 and a > b"),
    "sql_leq": (_R, "select a from R where a <= 5"),
    "sql_case": (_R, "select a, case when a > 5 then 0 when a > 3 then 1 else 2 end as v from R"),
    "sql_case_simple": (_R, "select a, case a when 5 then 0 else 1 end as v from R"),
    "sql_between": (_R, "select a * b as v from R where a between 5 and 10"),
    "sql_date": (_R, "select a from R where day > date '2001-01-01'"),
    "sql_in_list": (_R, "select a * b as v from R where b in (1, 2, 3)"),
    "sql_not_in_list": (_R, "select a from R where b not in (1, 2, 3)"),
    "sql_in_subquery": (_R, "select a * b as v from R where a in (select b from R)"),
    "sql_not_in_subquery": (_R, "select a from R where a not in (select b from R)"),
    "sql_exists": (_R, "select a * b as v from R where exists (select a from R where a > 10)"),
    "sql_scalar_subquery": (_R, "select a from R where a > (select sum(b) / 5 from R)"),
    "sql_join_on": (_R + _S, "select a * d as v from R join S on (b = c)"),
    "sql_theta_join": (_R + _S, "select a * d as v from R join S on (b < c)"),
    "sql_mixed_join": (_R + _S, "select a * d as v from R join S on (b = c and a < d)"),
    "sql_comma_join": (_R + _S, "select a * d as v from R, S where b = c"),
    "sql_join_max": (_R + _S, "select b, max(d) as v from R, S where b = c group by b"),
    "sql_cross": (_R + _S, "select a * d as v from R, S"),
    "sql_join_sum": (_R + _S, "select a, cast(sum(d) as bigint) as v from R, S where b = c group by a"),
    "sql_using": (_R + "create table S2(b int, c int);", "select a * c as v from R join S2 using (b)"),
    "sql_three_way": (_R + _S + _T, "select a * f as v from R, S, T where b = c and d = e"),
    "sql_bushy": (_R + _S + _T + _U, "select a * h as v from (select a, d from R, S where b = c) x, (select e, h from T, U where f = g) y where d = e"),
    "sql_left_join": (_R + _S, "select a, d from R left join S on a = c"),
    "sql_right_join": (_R + _S, "select a, d from R right join S on a = d"),
    "sql_full_join": (_R + _S, "select a, d from R full join S on a = d"),
    "sql_natural_join": (_R + "create table S2(b int, c int);", "select a, c from R natural join S2"),
    "sql_star": (_R + _S, "select R.a, S.* from R join S on b = c"),
}

for _name, (_decl, _select) in _SCRIPTS.items():
    query(_name, _DATA + _select)(lambda spark, d, s=f"{_decl} {_select};": run_script(spark, s, _tables(spark, d)))


def sql_query(name: str, text: str, oracle: str | None = None, tables: str = "") -> None:
    """A query that is SQL over the named tables on both sides."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d, tables.split())
        return spark.sql(text)

    query(name, oracle or text)(run)


# what a user of SQL expects besides; extensions, not parity
sql_query("sql_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", tables="customer")
sql_query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", tables="orders")
sql_query("sql_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand NOT LIKE '%1'", tables="part")
sql_query("sql_avg_count_distinct", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n, CAST(avg(CAST(c_custkey AS DOUBLE)) AS DOUBLE) AS m FROM customer GROUP BY c_nationkey", tables="customer")
sql_query("sql_correlated_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", tables="customer orders")
sql_query("sql_set_operations", "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region)", tables="customer supplier nation region")
sql_query("sql_with", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t GROUP BY n", tables="orders")
sql_query("ext_window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", oracle="SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS r FROM orders", tables="orders")
sql_query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", tables="lineitem")
sql_query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", tables="lineitem")
