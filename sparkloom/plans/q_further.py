"""Queries of clocks, seeded values, cursors, join selection, staging, shared values, keyed stores and barriers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from sparkloom.functions import arrays as A, scalar as S
from sparkloom.operators import indexed, joins, poly
from sparkloom.operators.arrowtools import map_arrow
from sparkloom.plans import ml
from sparkloom.plans.q_sql import sql_query
from sparkloom.plans.registry import query
from sparkloom.streaming import core
from sparkloom.tables import table

# scalar functions


@query("fn_constants", "SELECT r_regionkey, 'abcdefghijklmnopqrstuvwxyz' AS lower, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, '0123456789' AS digits, '0123456789abcdefABCDEF' AS hex, '01234567' AS octal, 52::INT AS n_letters, 2147483647 AS max_int FROM region")
def fn_constants(spark: SparkSession, d: str):
    texts = {"lower": S.ASCII_LOWER, "upper": S.ASCII_UPPER, "digits": S.DIGITS, "hex": S.HEX_DIGITS, "octal": S.OCTAL_DIGITS}
    return table(spark, d, "region").select("r_regionkey", *[F.lit(v).alias(k) for k, v in texts.items()], F.length(F.lit(S.ASCII_LETTERS)).alias("n_letters"), F.lit(S.MAX_INT).alias("max_int"))


@query(
    "fn_parse_date",
    """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, NULL::INT AS none,
       year(o_orderdate)::INT * 10000 + month(o_orderdate)::INT * 100 + day(o_orderdate)::INT AS n FROM orders""",
)
def fn_parse_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("t"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("u"))
    parsed = S.parse_date(F.col("t"), "dd.MM.yyyy")
    return o.select("o_orderkey", parsed.alias("p"), S.parse_date(F.col("t"), "yyyy/MM/dd").alias("q"), S.parse_sql_date(F.col("u")).alias("n")).select("o_orderkey", "p.*", F.col("q.y").alias("none"), "n")


@query(
    "fn_clock_parts",
    """SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, year(ts)::INT AS y, day(ts + INTERVAL 9 HOUR)::INT AS far_d, hour(ts + INTERVAL 9 HOUR)::INT AS far_h,
       strftime(ts, '%H:%M on %d/%m') AS t, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H') AS far_t FROM events""",
)
def fn_clock_parts(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    ts, far = F.col("ts"), ("Asia/Tokyo", "UTC")
    e = e.select("event_id", S.time_parts(ts).alias("c"), S.date_parts(ts).alias("d"), S.time_parts(ts, *far).alias("f"), S.time_text(ts, "HH:mm 'on' dd/MM").alias("t"), S.time_text(ts, "yyyyMMddHH", *far).alias("far_t"))
    return e.select("event_id", "c.*", "d.y", F.substring("far_t", 7, 2).cast("int").alias("far_d"), F.col("f.h").alias("far_h"), "t", "far_t")


@query("fn_now", "SELECT true AS clocks_agree, true AS dates_agree")
def fn_now(spark, d):
    """Clocks of one query stand still, so their parts must make the same moment, whatever the session's zone."""
    row = spark.range(1).select(S.now_millis().alias("ms"), S.utc_date().alias("d"), S.utc_time().alias("t"), S.local_date().alias("ld"), S.local_time().alias("lt"), F.current_timestamp().alias("now"))
    day = S.date_parts(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / 86_400_000).cast("int")))
    seconds = F.col("t.h") * 3600 + F.col("t.m") * 60 + F.col("t.s")
    return row.select((F.floor(F.col("ms") / 1000) % 86400 == seconds).alias("clocks_agree"), ((F.col("d") == day) & (F.col("ld.y") == F.year("now")) & (F.col("lt.h") == F.hour("now"))).alias("dates_agree"))


@query("fn_tan", "SELECT event_id, round(tan(value / 100), 6) AS t FROM events WHERE value < 150")
def fn_tan(spark, d):
    return table(spark, d, "events").where("value < 150").select("event_id", F.round(F.tan(F.col("value") / 100), 6).alias("t"))


@query("fn_seeded_ranges", "SELECT o_orderkey, true AS same, true AS word, true AS trials, true AS fraction, true AS vector, 0.0::DOUBLE AS zero FROM orders")
def fn_seeded_ranges(spark, d):
    """Seeded values are the same on each call and within their ranges."""
    k = F.col("o_orderkey")
    w, b, v = S.seeded_word(7, k), S.seeded_binomial(20, 0.3, k), A.hashed_vector(5, k)
    return table(spark, d, "orders").select(
        "o_orderkey", ((S.hash_of(k) == S.hash_of(k)) & (w == S.seeded_word(7, k))).alias("same"), w.rlike("^[a-z]{7}$").alias("word"), b.between(0, 20).alias("trials"),
        S.seeded_fraction(k).between(0, 1).alias("fraction"), (F.forall(v, lambda x: x.between(0, 1)) & (F.size(v) == 5)).alias("vector"), F.aggregate(A.zero_vector(4), F.lit(0.0), lambda a, x: a + x).alias("zero"),
    )


@query("fn_seeded_means", "SELECT true AS trials, true AS fraction, true AS letters")
def fn_seeded_means(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    means = table(spark, d, "lineitem").agg(F.avg(S.seeded_binomial(20, 0.3, k)).alias("b"), F.avg(S.seeded_fraction(k)).alias("f"), F.avg((F.ascii(S.seeded_word(1, k)) - 97).cast("double")).alias("w"))
    return means.select(F.col("b").between(5.8, 6.2).alias("trials"), F.col("f").between(0.48, 0.52).alias("fraction"), F.col("w").between(12, 13).alias("letters"))


@query("bitset_iterate", "SELECT n_regionkey AS k, n_nationkey AS member FROM nation")
def bitset_iterate(spark, d):
    b = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(A.bits(F.collect_set("n_nationkey")).alias("b"))
    return b.select("k", A.iterate_bits(F.col("b")).alias("member"))


@query("array_length", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def array_length(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.array_size(F.col("embedding")).alias("n"))


# cursors

_CURSOR = """WITH RECURSIVE b AS (SELECT user_id, event_id AS seq, (event_id % 3)::INT AS tag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events),
 c AS (SELECT * FROM b WHERE place = {low} UNION ALL SELECT b.* FROM c JOIN b ON b.user_id = c.user_id AND b.place = c.place + c.tag + 1 WHERE b.place < {high})
 SELECT user_id, place, seq, tag FROM c"""


def _buffer(spark, d):
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("tag"))


@query("poly_traverse", _CURSOR.format(low=0, high=1 << 60))
def poly_traverse(spark, d):
    return poly.traverse(_buffer(spark, d), ["user_id"], ["seq"], lambda tag, place, n: tag + 1)


@query("poly_traverse_range", _CURSOR.format(low=2, high=6))
def poly_traverse_range(spark, d):
    return poly.traverse(_buffer(spark, d), ["user_id"], ["seq"], lambda tag, place, n: tag + 1, 2, 6)


# joins by what the sides are


@query("join_selected_small", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_selected_small(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return joins.select_join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), n, ["k"]).select("c_custkey", "n_name")


@query("join_selected_skew", "SELECT m.dest_peer, count(*) AS n, count(p.role) AS with_role FROM messages m LEFT JOIN peers p ON m.dest_peer = p.address GROUP BY ALL")
def join_selected_skew(spark, d):
    """As if peers were too many to broadcast: hot peers take a way of their own."""
    m = table(spark, d, "messages").select("dest_peer")
    p = table(spark, d, "peers").select(F.col("address").alias("dest_peer"), "role")
    return joins.skew_join(m, p, ["dest_peer"], "left", 0.05, most=0).groupBy("dest_peer").agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("with_role"))


@query(
    "join_ordered",
    """SELECT r_name, count(*) AS mult FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def join_ordered(spark, d):
    """Five relations with multiplicities, joined from the smallest on."""
    pick = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey", "r_name"]}
    names = {"l_orderkey": "order", "o_orderkey": "order", "o_custkey": "cust", "c_custkey": "cust", "c_nationkey": "nation", "n_nationkey": "nation", "n_regionkey": "region", "r_regionkey": "region"}
    relations = [joins.with_multiplicity(table(spark, d, t).select(*[F.col(c).alias(names.get(c, c)) for c in columns])) for t, columns in pick.items()]
    return joins.collapse(joins.ordered_multiway(relations).select("r_name", "mult"))


@query("index_fold_slices", "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS n FROM nation")
def index_fold_slices(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9900").withColumnRenamed("c_nationkey", "n_nationkey")
    folded = indexed.fold_slices(rich, table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], n=F.count(F.lit(1)))
    return folded.fillna(0, ["n"])


@query("join_staged", "SELECT o_orderpriority, count(*) AS n, max(x) AS most FROM orders JOIN (SELECT l_orderkey, count(*) AS x FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY ALL")
def join_staged(spark, d):
    """A fold as a stage of its own, used by SQL under a name."""
    joins.staged(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("x")), "lines_per_order")
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderpriority, count(*) AS n, max(x) AS most FROM orders JOIN lines_per_order ON l_orderkey = o_orderkey GROUP BY o_orderpriority")


@query("pinned_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pinned_lookup(spark, d):
    """A fixed table sent once to each executor and made into a dictionary once in each worker."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 by nature
    names = joins.Pinned(table(spark, d, "customer"), [tuple(r) for r in rows], dict)

    def look(batch: pa.RecordBatch):
        held = names.get()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held.get(k) for k in batch.column(1).to_pylist()], pa.string())], names=["c_custkey", "n_name"])

    return map_arrow(table(spark, d, "customer").select("c_custkey", "c_nationkey"), look, "c_custkey bigint, n_name string")


@query("profile_observed", "SELECT 'nation' AS name, count(*) AS rows, sum(8 + 8 + strlen(n_name))::BIGINT AS bytes FROM nation")
def profile_observed(spark, d):
    """Rows and bytes counted while the query runs."""
    df, seen = joins.profiled(table(spark, d, "nation").select("n_nationkey", "n_name"), "nation")
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("nation", seen.get["rows"], seen.get["bytes"])], "name string, rows long, bytes long")


# SQL

sql_query("sql_recursive", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a AS fibonacci FROM f")
sql_query("sql_cast_null_interval", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(NULL AS INT) AS none, NULLIF(o_orderstatus, 'F') AS open, CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS due FROM orders", tables="orders")
sql_query("sql_is_null", "SELECT trigger IS NULL AS no_trigger, count(*) AS n, count(source_peer) AS with_source FROM messages GROUP BY trigger IS NULL", tables="messages")
sql_query(
    "sql_table_function",
    "SELECT n_nationkey, i FROM nation, LATERAL explode(sequence(0, n_regionkey)) AS t(i)",
    oracle="SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INT AS i FROM nation",
    tables="nation",
)

# keyed state


@query(
    "stream_kv_store",
    """WITH p AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'view') SELECT g.user_id, g.event_id, arg_max(p.value, p.event_id) AS value FROM (SELECT * FROM events WHERE event_type = 'view') g
       LEFT JOIN p ON p.user_id = g.user_id AND p.event_id < g.event_id GROUP BY g.user_id, g.event_id""",
)
def stream_kv_store(spark, d):
    e = core.read_stream(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("put"))
    return core.run_to_end(core.key_value_store(e, "user_id", "event_id", "put"))


@query("stream_on_count", "SELECT user_id, 1::BIGINT AS fired FROM events GROUP BY user_id HAVING count(*) >= 12")
def stream_on_count(spark, d):
    return core.run_to_end(core.on_count(core.read_stream(spark, d, "events"), "user_id", 12))


@query("stream_on_each_count", "SELECT user_id, unnest(range(1, count(*) // 5 + 1)) AS fired FROM events GROUP BY user_id")
def stream_on_each_count(spark, d):
    return core.run_to_end(core.on_count(core.read_stream(spark, d, "events"), "user_id", 5, reset=True))


@query("autoencoder", "SELECT true AS learns, 64 AS dims, 8 AS hidden")
def autoencoder(spark, d):
    """Whether the error falls in each round; the weights depend on the data alone."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    weights, losses = ml.autoencoder(v, "vec_id", "e", 64)
    falls = all(b < a for a, b in zip(losses, losses[1:]))
    return spark.createDataFrame([(falls, *weights[0].shape)], "learns boolean, dims int, hidden int")
