"""Queries that run streams to their end; each gives what the batch query gives."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from sparkloom.plans.registry import query
from sparkloom.streaming import core as S
from sparkloom.tables import table

MONEY = "decimal(18,4)"


@query("stream_running_agg", f"SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS {MONEY})) AS DOUBLE) AS total FROM events GROUP BY user_id")
def stream_running_agg(spark: SparkSession, d: str):
    agg = S.running_aggregate(S.read_stream(spark, d, "events"), ["user_id"], n=F.count(F.lit(1)), total=F.sum(F.col("value").cast(MONEY)).cast("double"))
    return S.run_to_end(agg, "update", ["user_id"])


@query("stream_complete", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_complete(spark, d):
    return S.run_to_end(S.read_stream(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("stream_trigger", "SELECT event_id, value * 2 AS v FROM events WHERE event_type = 'purchase'")
def stream_trigger(spark, d):
    return S.run_to_end(S.read_stream(spark, d, "events").where("event_type = 'purchase'").select("event_id", (F.col("value") * 2).alias("v")))


@query("stream_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_join(spark, d):
    o, c = S.read_stream(spark, d, "orders"), S.read_stream(spark, d, "customer")
    return S.run_to_end(S.symmetric_join(o, c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment"))


@query("stream_static_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def stream_static_join(spark, d):
    c = S.read_stream(spark, d, "customer")
    return S.run_to_end(c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    return S.run_to_end(S.deduplicate(S.read_stream(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"]))


@query(
    "stream_signed_agenda",
    f"SELECT user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS \"count\", CAST(sum(CAST(value AS {MONEY}) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS DOUBLE) AS total FROM events GROUP BY user_id",
)
def stream_signed_agenda(spark, d):
    e = S.read_stream(spark, d, "events").select("user_id", F.col("value").cast(MONEY).alias("v"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"))
    return S.run_to_end(S.signed_totals(e, ["user_id"], "sign", total="v"), "update", ["user_id"]).withColumn("total", F.col("total").cast("double"))


@query("ext_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    e = S.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    agg = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = S.run_to_end(agg, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "ext_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id,
       CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def ext_session(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("ext_approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type")
def ext_approx_distinct(spark, d):
    """Whether the sketch is within four standard errors of the exact number."""
    users = F.count_distinct("user_id")
    return table(spark, d, "events").groupBy("event_type").agg(users.alias("users"), (F.abs(F.approx_count_distinct("user_id", 0.02) - users) <= 0.08 * users).alias("near"))


@query(
    "versioned_correction",
    """WITH v AS (SELECT o_custkey AS key, o_orderkey AS vid FROM orders), l AS (SELECT c_custkey AS key, c_custkey * 9 AS vid, 1 AS amount FROM customer)
       SELECT v.key, v.vid, (SELECT count(*) FROM l WHERE l.key = v.key AND l.vid < v.vid) AS correction FROM v""",
)
def versioned_correction(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("vid"))
    late = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 9).alias("vid"), F.lit(1).cast("long").alias("amount"))
    return S.corrected_snapshots(v, ["key"], "vid", late, "amount").select("key", "vid", "correction")


@query("stream_timers", "SELECT user_id, epoch_us(max(ts) + INTERVAL 1 MINUTE) // 1000 AS fires_at, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events)")
def stream_timers(spark, d):
    """A timer a minute after the last event of each user, which newer events put off; it fires once the stream has got that far."""
    e = S.read_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.run_to_end(S.delayed(e, "user_id", "ts", 60_000))
