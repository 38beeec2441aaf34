"""Queries of bags, sequences and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkloom.operators import bag, sets
from sparkloom.operators.joins import theta_join
from sparkloom.plans.registry import query
from sparkloom.tables import table

MONEY = "decimal(18,4)"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    """Region keys of nations: a bag with repeats."""
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("k"))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@query("bag_size", "SELECT count(*) AS size FROM lineitem")
def bag_size(spark, d):
    return bag.size(table(spark, d, "lineitem"))


@query("bag_clear", "SELECT count(*) AS size FROM orders WHERE false")
def bag_clear(spark, d):
    return bag.size(bag.clear(table(spark, d, "orders")))


@query("bag_peek", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1")
def bag_peek(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = bag.peek(rows, ["o_orderkey"])
    return spark.createDataFrame([first] if first else [], rows.schema)


@query("seq_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def seq_positions(spark, d):
    return bag.with_position(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


@query("seq_at", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 100")
def seq_at(spark, d):
    return bag.at(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey")


@query("seq_safe_at", "SELECT CAST(-1 AS INT) AS r_regionkey, 'none' AS r_name")
def seq_safe_at(spark, d):
    return bag.safe_at(table(spark, d, "region"), ["r_regionkey"], 99, (-1, "none"))


@query("seq_pop", "SELECT count(*) AS n, min(o_orderkey) AS least FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1)")
def seq_pop(spark, d):
    return bag.pop(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@query("seq_sort", "SELECT e_rank AS place, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS e_rank FROM events)")
def seq_sort(spark, d):
    rows = table(spark, d, "events").select("event_id", (-F.col("value")).alias("v"))
    return bag.with_position(rows, ["v", "event_id"], "place").select("place", "event_id")


@query("bag_insert", "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL VALUES (5), (5), (4)) GROUP BY k")
def bag_insert(spark, d):
    return _counted(bag.insert(_nations(spark, d), (5,), (5,), (4,)))


@query("bag_combine", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def bag_combine(spark, d):
    return _counted(bag.combine(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))))


@query("bag_extend", "SELECT count(*) AS size FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer)")
def bag_extend(spark, d):
    return bag.size(bag.extend(table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))))


@query("bag_update", "SELECT k, count(*) - (k = 0)::INT + (k = 1)::INT AS n FROM (SELECT n_regionkey AS k FROM nation) GROUP BY k")
def bag_update(spark, d):
    return _counted(bag.update(_nations(spark, d), (0,), (1,)))


@query("bag_update_absent", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY k")
def bag_update_absent(spark, d):
    return _counted(bag.update(_nations(spark, d), (77,), (1,)))


@query("bag_erase", "SELECT k, count(*) - (k = 2)::INT AS n FROM (SELECT n_regionkey AS k FROM nation) GROUP BY k")
def bag_erase(spark, d):
    return _counted(bag.erase(_nations(spark, d), (2,)))


@query(
    "bag_split",
    """SELECT half, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= c // 2 THEN 1 ELSE 2 END AS half
       FROM orders, (SELECT count(*) AS c FROM orders)) GROUP BY half""",
)
def bag_split(spark, d):
    halves = bag.split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    rows = reduce(DataFrame.unionByName, [h.withColumn("half", F.lit(i + 1)) for i, h in enumerate(halves)])
    return rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("bag_map", f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS {MONEY}) * (1 - CAST(l_discount AS {MONEY})) AS DOUBLE) AS revenue FROM lineitem")
def bag_map(spark, d):
    net = F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(MONEY))
    return bag.project(table(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), revenue=net.cast("double"))


@query("bag_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND value > 50 AND user_id % 2 = 0")
def bag_filter(spark, d):
    wanted = (F.col("event_type").isin("click", "view"), F.col("value") > 50, F.col("user_id") % 2 == 0)
    return bag.keep(table(spark, d, "events"), *wanted).select("event_id", "event_type")


@query("bag_fold", f"SELECT CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS total, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM orders")
def bag_fold(spark, d):
    return bag.fold(table(spark, d, "orders"), total=F.sum(F.col("o_totalprice").cast(MONEY)).cast("double"), n=F.count(F.lit(1)), least=F.min("o_orderkey"), greatest=F.max("o_orderkey"))


@query("bag_group_by", f"SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def bag_group_by(spark, d):
    return bag.group_by(table(spark, d, "orders"), ["o_custkey"], n=F.count(F.lit(1)), total=F.sum(F.col("o_totalprice").cast(MONEY)).cast("double"))


@query(
    "group_by_contiguous",
    "SELECT key, coalesce(n, 0) AS n, coalesce(most, 0) AS most FROM (SELECT range AS key FROM range(64)) LEFT JOIN (SELECT p_size::BIGINT AS key, count(*) AS n, max(p_partkey) AS most FROM part GROUP BY ALL) USING (key)",
)
def group_by_contiguous(spark, d):
    return bag.group_by_contiguous(table(spark, d, "part"), F.col("p_size"), 64, {"n": 0, "most": 0}, n=F.count(F.lit(1)), most=F.max("p_partkey"))


@query(
    "fold_ordered",
    "SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(CAST(floor(value) AS BIGINT) ORDER BY ts, event_id)), lambda a, b: (a * 31 + b) % 1000003) AS acc FROM events GROUP BY user_id",
)
def fold_ordered(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.floor("value").cast("long"))
    return bag.fold_ordered(rows, ["user_id"], ["ts", "event_id"], "v", 0, lambda a, x: (a * 31 + int(x)) % 1000003, "acc", T.LongType())


@query("seq_running", f"SELECT event_id, count(*) OVER w AS n, CAST(sum(CAST(value AS {MONEY})) OVER w AS DOUBLE) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def seq_running(spark, d):
    rows = bag.running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"n": "sum", "total": "sum"}, n=F.count(F.lit(1)), total=F.sum(F.col("value").cast(MONEY)))
    return rows.select("event_id", "n", F.col("total").cast("double").alias("total"))


@query("bag_ext", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")
def bag_ext(spark, d):
    return _counted(bag.ext(table(spark, d, "part"), F.split("p_name", " "), "word").where("word <> ''"))


@query("bag_join_theta", "SELECT a.n_name AS l, b.n_name AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def bag_join_theta(spark, d):
    n = table(spark, d, "nation")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return theta_join(n.alias("a"), n.alias("b"), on).select(F.col("a.n_name").alias("l"), F.col("b.n_name").alias("r"))


@query("bag_equijoin", "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def bag_equijoin(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


_KV = "(SELECT o_custkey AS key, count(*) AS value FROM orders GROUP BY ALL)"


def _kv(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("value"))


@query("bag_equijoin_kv", f"SELECT c_custkey, value FROM customer JOIN {_KV} ON c_custkey = key")
def bag_equijoin_kv(spark, d):
    return table(spark, d, "customer").join(_kv(spark, d), F.col("c_custkey") == F.col("key")).select("c_custkey", "value")


@query("bag_join_kv", f"SELECT n_name, count(*) AS n FROM nation JOIN {_KV} ON value > n_nationkey + 10 GROUP BY n_name")
def bag_join_kv(spark, d):
    joined = theta_join(_kv(spark, d), table(spark, d, "nation"), F.col("value") > F.col("n_nationkey") + 10)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("equijoinkf_kv", f"SELECT sum(c_nationkey * value)::BIGINT AS total, count(*) AS n FROM customer JOIN {_KV} ON c_custkey = key")
def equijoinkf_kv(spark, d):
    return bag.fused_join_fold(table(spark, d, "customer"), _kv(spark, d), F.col("c_custkey") == F.col("key"), F.sum(F.col("c_nationkey") * F.col("value")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("bag_split_many", "SELECT chunk, count(*) AS n, min(o_orderkey) AS least FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) GROUP BY chunk")
def bag_split_many(spark, d):
    return bag.split_many(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@query("bag_iterate", "SELECT sum(n_nationkey)::BIGINT AS total FROM nation")
def bag_iterate(spark, d):
    """A side effect per row, here into an accumulator."""
    total = spark.sparkContext.accumulator(0)
    bag.iterate(table(spark, d, "nation"), lambda r: total.add(r.n_nationkey))
    return spark.createDataFrame([(total.value,)], "total long")


# sets: nations with customers and nations with suppliers of a positive balance

_A = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"
_B = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'"


def _a(spark, d):
    return sets.as_set(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


def _b(spark, d):
    return sets.as_set(table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k")))


@query("set_union", f"{_A} UNION {_B}")
def set_union(spark, d):
    return sets.union(_a(spark, d), _b(spark, d))


@query("set_intersect", f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    return sets.intersect(_a(spark, d), _b(spark, d))


@query("set_difference", f"({_A}) EXCEPT ({_B})")
def set_difference(spark, d):
    return sets.difference(_a(spark, d), _b(spark, d))


@query("set_member", f"SELECT c_custkey AS k, c_custkey IN ({_A}) AS member FROM customer")
def set_member(spark, d):
    return sets.member(_a(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("set_subset", f"SELECT NOT EXISTS ({_A} EXCEPT SELECT c_custkey FROM customer) AS is_subset")
def set_subset(spark, d):
    return sets.is_subset_of(_a(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("set_not_subset", f"SELECT NOT EXISTS (({_A}) EXCEPT ({_B})) AS is_subset")
def set_not_subset(spark, d):
    return sets.is_subset_of(_a(spark, d), _b(spark, d))


@query("set_insert", f"SELECT count(*) AS n FROM ({_A} UNION VALUES (-1), (-1))")
def set_insert(spark, d):
    return sets.insert(_a(spark, d), (-1,), (-1,)).agg(F.count(F.lit(1)).alias("n"))


@query("set_erase", "SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_regionkey <> 3")
def set_erase(spark, d):
    return sets.erase(_nations(spark, d), (3,))


@query("set_update", "SELECT DISTINCT CASE WHEN n_regionkey = 3 THEN 30 ELSE n_regionkey END AS k FROM nation")
def set_update(spark, d):
    return sets.update(_nations(spark, d), (3,), (30,))


@query("set_map", "SELECT DISTINCT user_id % 10 AS k FROM events")
def set_map(spark, d):
    return sets.project(table(spark, d, "events"), k=F.col("user_id") % 10)
