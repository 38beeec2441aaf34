"""Queries of expression operators, user functions and request streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from sparkloom.functions import scalar as S
from sparkloom.operators import joins
from sparkloom.plans.registry import query
from sparkloom.tables import table


@query(
    "expr_arithmetic",
    """SELECT event_id, event_id + user_id AS plus, event_id - user_id AS minus, event_id * 3 AS times, event_id // 7 AS int_quotient, value / 4 AS quotient, event_id % 7 AS remainder, -event_id AS negated,
       ((event_id - 50) % 7 + 7) % 7 AS modulo, 'e' || CAST(event_id AS VARCHAR) AS text FROM events""",
)
def expr_arithmetic(spark: SparkSession, d: str):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        "event_id", (e + u).alias("plus"), (e - u).alias("minus"), (e * 3).alias("times"), S.int_div(e, F.lit(7)).alias("int_quotient"), (F.col("value") / 4).alias("quotient"), (e % 7).alias("remainder"),
        (-e).alias("negated"), F.pmod(e - 50, F.lit(7)).alias("modulo"), F.concat(F.lit("e"), e.cast("string")).alias("text"),
    )


@query("expr_boolean", "SELECT event_id, (value > 50 AND user_id > 10) AS a, (value > 50 OR user_id > 10) AS o, NOT (value > 50) AS n, user_id <> 3 AS ne FROM events")
def expr_boolean(spark, d):
    big, late = F.col("value") > 50, F.col("user_id") > 10
    return table(spark, d, "events").select("event_id", (big & late).alias("a"), (big | late).alias("o"), (~big).alias("n"), (F.col("user_id") != 3).alias("ne"))


@query("expr_structural", "SELECT n_nationkey, (n_regionkey, n_nationkey) < (2, 10) AS lt, (n_regionkey = 2 AND n_nationkey = 2) AS eq FROM nation")
def expr_structural(spark, d):
    """Records compare field by field."""
    pair = F.struct(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))
    return table(spark, d, "nation").select("n_nationkey", (pair < F.struct(F.lit(2).alias("a"), F.lit(10).alias("b"))).alias("lt"), (pair == F.struct(F.lit(2).alias("a"), F.lit(2).alias("b"))).alias("eq"))


@query("expr_option", "SELECT mess_id, job_id, dest_peer, coalesce('from ' || source_peer, 'nobody') AS sender, count(*) AS n FROM messages GROUP BY ALL")
def expr_option(spark, d):
    """case of Some and None: a null is None."""
    sender = F.when(F.col("source_peer").isNotNull(), F.concat(F.lit("from "), F.col("source_peer"))).otherwise("nobody")
    return table(spark, d, "messages").groupBy("mess_id", "job_id", "dest_peer", sender.alias("sender")).agg(F.count(F.lit(1)).alias("n"))


@query("expr_bind", "SELECT o_orderkey, o_custkey + o_orderkey AS both FROM orders")
def expr_bind(spark, d):
    """Destructuring of a record into its fields."""
    packed = table(spark, d, "orders").select(F.struct(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).alias("r"))
    return packed.select("r.*").select(F.col("k").alias("o_orderkey"), (F.col("c") + F.col("k")).alias("both"))


@query("udf_vectorised", "SELECT event_id, value * 2 + 1 AS v FROM events")
def udf_vectorised(spark, d):
    """A host-language function, in Arrow batches."""
    double = F.pandas_udf(lambda x: x * 2 + 1, "double")
    return table(spark, d, "events").select("event_id", double("value").alias("v"))


@query("udaf_grouped", "SELECT user_id, max(event_id) - min(event_id) AS spread FROM events GROUP BY user_id")
def udaf_grouped(spark, d):
    """A user aggregate with zero, accumulate and merge: partial results per partition in Python, merged as built-in aggregates."""

    def partial(batches):
        for b in batches:
            g = b.groupby("user_id")["event_id"].agg(["min", "max"]).reset_index()
            yield pd.DataFrame({"user_id": g["user_id"], "lo": g["min"], "hi": g["max"]})

    parts = table(spark, d, "events").select("user_id", "event_id").mapInPandas(partial, "user_id long, lo long, hi long")
    return parts.groupBy("user_id").agg((F.max("hi") - F.min("lo")).alias("spread"))


@query("udtf_words", "SELECT part, count(*) AS n FROM (SELECT unnest(regexp_extract_all(p_name, '[a-z]+')) AS part FROM part) GROUP BY part")
def udtf_words(spark, d):
    """A table function of a row: rows out of each row, by Arrow batches."""
    import re

    word = re.compile("[a-z]+")

    def split(batches):
        for b in batches:
            yield pd.DataFrame({"part": [w for t in b["p_name"].dropna() for w in word.findall(t)]}, dtype="object")

    return table(spark, d, "part").select("p_name").mapInPandas(split, "part string").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kv_get_put",
    """WITH p AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'view') SELECT g.event_id, arg_max(p.value, p.event_id) AS value FROM (SELECT * FROM events WHERE event_type = 'view') g
       LEFT JOIN p ON p.user_id = g.user_id AND p.event_id < g.event_id GROUP BY g.event_id""",
)
def kv_get_put(spark, d):
    """A store of requests in order: each get sees the newest put of its key before it."""
    e = table(spark, d, "events")
    puts = e.where("event_type <> 'view'").select("user_id", F.col("event_id").alias("put_id"), "value")
    gets = e.where("event_type = 'view'").select("event_id", "user_id")
    return joins.asof_join(gets, puts, ["user_id"], "event_id", "put_id", strict=True).select("event_id", "value")
