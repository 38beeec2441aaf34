"""Queries of ordered, keyed, versioned and indexed collections and of tagged-union buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators import indexed, keyed, ordered, poly, versioned
from sparkloom.plans.registry import query
from sparkloom.sources import files
from sparkloom.tables import table

MONEY = "decimal(18,4)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


_O = "SELECT o_orderkey, o_custkey FROM orders"

for _name, _f, _sql in (
    ("sorted_min", lambda df: ordered.least(df, "o_orderkey"), "ORDER BY o_orderkey LIMIT 1"),
    ("sorted_max", lambda df: ordered.greatest(df, "o_orderkey"), "ORDER BY o_orderkey DESC LIMIT 1"),
    ("sorted_lower_bound", lambda df: ordered.lower_bound(df, "o_orderkey", 500), "WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 1"),
    ("sorted_upper_bound", lambda df: ordered.upper_bound(df, "o_orderkey", 500), "WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1"),
    ("smap_lookup_lt", lambda df: ordered.lookup_lt(df, "o_orderkey", 500), "WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 1"),
    ("smap_lookup_leq", lambda df: ordered.lookup_leq(df, "o_orderkey", 500), "WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 1"),
    ("smap_lookup_gt", lambda df: ordered.lookup_gt(df, "o_orderkey", 500), "WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1"),
    ("smap_lookup_geq", lambda df: ordered.lookup_geq(df, "o_orderkey", 500), "WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 1"),
    ("smap_lookup_none", lambda df: ordered.lookup_lt(df, "o_orderkey", -1), "WHERE o_orderkey < -1"),
    ("sorted_filter_lt", lambda df: ordered.filter_lt(df, "o_orderkey", 500), "WHERE o_orderkey < 500"),
    ("sorted_filter_gt", lambda df: ordered.filter_gt(df, "o_orderkey", 500), "WHERE o_orderkey > 500"),
    ("sorted_filter_leq", lambda df: ordered.filter_leq(df, "o_orderkey", 500), "WHERE o_orderkey <= 500"),
    ("sorted_filter_geq", lambda df: ordered.filter_geq(df, "o_orderkey", 500), "WHERE o_orderkey >= 500"),
    ("sorted_between", lambda df: ordered.between(df, "o_orderkey", 200, 900), "WHERE o_orderkey BETWEEN 200 AND 900"),
    ("sorted_erase_before", lambda df: ordered.erase_before(df, "o_orderkey", 700), "WHERE o_orderkey >= 700"),
    ("sorted_erase_after", lambda df: ordered.erase_after(df, "o_orderkey", 700), "WHERE o_orderkey <= 700"),
):
    query(_name, f"{_O} {_sql}")(lambda spark, d, f=_f: f(_orders(spark, d)))

_RATES = "(SELECT CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS first_order FROM orders GROUP BY ALL)"
for _mode, _op, _dir in (("leq", "<=", "DESC"), ("lt", "<", "DESC"), ("geq", ">=", "ASC"), ("gt", ">", "ASC")):

    def _nearest(spark, d, mode=_mode):
        ship = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"))
        days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("first_order"))
        return ordered.nearest(ship, "ship", days, "day", "first_order", mode).drop("ship")

    _agg = {"leq": "max", "lt": "max", "geq": "min", "gt": "min"}[_mode]
    query(
        f"nearest_{_mode}",
        f"""WITH r AS {_RATES}, s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship FROM lineitem),
            n AS (SELECT ship, (SELECT {_agg}(r.day) FROM r WHERE r.day {_op} s.ship) AS day FROM s)
            SELECT l_orderkey, l_linenumber, n.day, first_order FROM lineitem JOIN n ON CAST(l_shipdate AS DATE) = n.ship LEFT JOIN r ON r.day = n.day""",
    )(_nearest)


@query(
    "range_join",
    """SELECT p_brand, count(*) AS n FROM supplier JOIN part ON s_acctbal BETWEEN p_retailprice - 20 AND p_retailprice + 20 GROUP BY p_brand""",
)
def range_join(spark, d):
    bands = table(spark, d, "part").select("p_brand", (F.col("p_retailprice") - 20).alias("low"), (F.col("p_retailprice") + 20).alias("high"))
    return ordered.pairs_between(table(spark, d, "supplier").select("s_acctbal"), "s_acctbal", bands, "low", "high", 40.0).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


# maps: customers by key, and the number of their orders

_CUST = "SELECT c_custkey AS key, c_nationkey AS value FROM customer"
_NEW = "SELECT o_custkey + 100 AS key, (count(*) + 1000)::INT AS value FROM orders GROUP BY o_custkey"


def _map(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))


def _new(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 1000).cast("int").alias("value")).select((F.col("o_custkey") + 100).alias("key"), "value")


_WON = f"WITH a AS ({_CUST}), b AS ({_NEW}) "


@query("map_insert", _WON + "SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.key = b.key")
def map_insert(spark, d):
    return keyed.insert(_map(spark, d), _new(spark, d), ["key"])


@query("map_combine", _WON + "SELECT coalesce(a.key, b.key) AS key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b ON a.key = b.key")
def map_combine(spark, d):
    return keyed.combine(_new(spark, d), _map(spark, d), ["key"])


@query("map_lookup", _WON + "SELECT b.key, b.value AS probe, coalesce(a.value, -1) AS value FROM b LEFT JOIN a ON a.key = b.key")
def map_lookup(spark, d):
    return keyed.lookup(_map(spark, d), _new(spark, d).withColumnRenamed("value", "probe"), ["key"], {"value": -1})


@query("map_member", _WON + "SELECT b.key, a.key IS NOT NULL AS member FROM b LEFT JOIN a ON a.key = b.key")
def map_member(spark, d):
    return keyed.member(_map(spark, d), _new(spark, d).select("key"), ["key"])


@query("map_update_key", _WON + "SELECT a.key, coalesce(b.value, a.value) AS value FROM a LEFT JOIN b ON a.key = b.key")
def map_update_key(spark, d):
    return keyed.update_key(_map(spark, d), _new(spark, d), ["key"])


@query("map_erase_key", _WON + "SELECT key, value FROM a WHERE key NOT IN (SELECT key FROM b)")
def map_erase_key(spark, d):
    return keyed.erase_key(_map(spark, d), _new(spark, d), ["key"])


@query("map_erase_with", _WON + "SELECT key, value FROM a WHERE key IN (SELECT key FROM b)")
def map_erase_with(spark, d):
    return keyed.erase_with(_map(spark, d), _new(spark, d), ["key"])[1]


@query("map_insert_with", f"SELECT key, sum(value)::BIGINT AS value FROM ({_CUST} UNION ALL {_NEW}) GROUP BY key")
def map_insert_with(spark, d):
    return keyed.insert_with(_map(spark, d), _new(spark, d), ["key"], value=F.sum)


@query("map_upsert_with", _WON + "SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 0 WHEN b.key IS NOT NULL THEN a.value + 1 ELSE a.value END AS value FROM a FULL JOIN b ON a.key = b.key")
def map_upsert_with(spark, d):
    return keyed.upsert_with(_map(spark, d), _new(spark, d), ["key"], {"value": F.lit(0)}, {"value": F.col("a.value") + 1})


@query("map_update_with", _WON + "SELECT a.key, a.value * 2 AS value FROM a JOIN b ON a.key = b.key")
def map_update_with(spark, d):
    return keyed.update_with(_map(spark, d), _new(spark, d), ["key"], {"value": F.col("value") * 2})


@query("map_project_last", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def map_project_last(spark, d):
    return keyed.project(table(spark, d, "events"), {"user_id": F.col("user_id")}, {"event_type": F.col("event_type")}, F.struct("ts", "event_id"))


@query("map_equijoin_fold", _WON + "SELECT sum(a.value * b.value)::BIGINT AS total, count(*) AS n FROM a JOIN b ON a.key = b.key")
def map_equijoin_fold(spark, d):
    new = _new(spark, d).withColumnRenamed("value", "other")
    return keyed.equijoin_fold(_map(spark, d), new, ["key"], total=F.sum(F.col("value").cast("long") * F.col("other")), n=F.count(F.lit(1)))


# versions: orders of a customer by the day number of their date

_V = "(SELECT o_custkey AS key, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS vid, max(o_orderkey) AS value FROM orders GROUP BY ALL)"


def _versions(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), day.alias("vid")).agg(F.max("o_orderkey").alias("value"))


@query("vmap_frontier", f"SELECT key, max(vid) AS vid, arg_max(value, vid) AS value FROM {_V} WHERE vid < 1200 GROUP BY key")
def vmap_frontier(spark, d):
    return versioned.frontier(_versions(spark, d), ["key"], "vid", 1200)


@query("vmap_size", f"SELECT count(DISTINCT key) AS size FROM {_V} WHERE vid <= 1200")
def vmap_size(spark, d):
    return versioned.size(_versions(spark, d), ["key"], "vid", 1200)


@query("vmap_total_size", f"SELECT count(*) AS total_size FROM {_V}")
def vmap_total_size(spark, d):
    return versioned.total_size(_versions(spark, d))


@query("vmap_lookup", f"SELECT key, vid, value FROM {_V} WHERE vid = 1200 AND key IN (SELECT c_custkey FROM customer)")
def vmap_lookup(spark, d):
    return versioned.lookup(_versions(spark, d), ["key"], "vid", 1200, table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query(
    "vmap_lookup_before",
    f"""WITH v AS {_V}, p AS (SELECT c_custkey AS key, 400 + c_nationkey * 50 AS at FROM customer)
        SELECT p.key, p.at, max(v.vid) AS vid, arg_max(v.value, v.vid) AS value FROM p LEFT JOIN v ON v.key = p.key AND v.vid < p.at GROUP BY p.key, p.at""",
)
def vmap_lookup_before(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") * 50 + 400).alias("at"))
    return versioned.lookup_before(_versions(spark, d), ["key"], "vid", probes, "at")


@query("vmap_gc", f"SELECT key, vid, value FROM {_V} v QUALIFY vid >= coalesce(max(CASE WHEN vid <= 1200 THEN vid END) OVER (PARTITION BY key), vid)")
def vmap_gc(spark, d):
    return versioned.erase_all_before(_versions(spark, d), ["key"], "vid", 1200)


@query("vmap_update_after", f"SELECT key, vid, CASE WHEN vid > 1200 THEN value + 7 ELSE value END AS value FROM {_V}")
def vmap_update_after(spark, d):
    return versioned.update_after(_versions(spark, d), "vid", 1200, value=F.col("value") + 7)


@query("vmap_peek_now", f"SELECT key, vid, value FROM {_V} ORDER BY key, vid DESC LIMIT 1")
def vmap_peek_now(spark, d):
    return versioned.peek_now(_versions(spark, d), ["key"], "vid").select("key", "vid", "value")


@query("vmap_fold_vid", f"SELECT sum(vid)::BIGINT AS vids, sum(value)::BIGINT AS total FROM (SELECT key, max(vid) AS vid, arg_max(value, vid) AS value FROM {_V} WHERE vid < 1200 GROUP BY key)")
def vmap_fold_vid(spark, d):
    return versioned.frontier(_versions(spark, d), ["key"], "vid", 1200).agg(F.sum("vid").alias("vids"), F.sum("value").alias("total"))


@query("vmap_fold_all", f"SELECT sum(vid)::BIGINT AS vids, sum(value)::BIGINT AS total FROM {_V}")
def vmap_fold_all(spark, d):
    return versioned.fold_all(_versions(spark, d), vids=F.sum("vid"), total=F.sum("value"))


@query("vmap_group_by", f"SELECT vid, count(*) AS n FROM (SELECT key, max(vid) AS vid FROM {_V} WHERE vid < 1200 GROUP BY key) GROUP BY vid")
def vmap_group_by(spark, d):
    return versioned.frontier(_versions(spark, d), ["key"], "vid", 1200).groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vmap_upsert_before",
    f"""WITH v AS {_V}, f AS (SELECT key, arg_max(value, vid) AS value FROM v WHERE vid < 1200 GROUP BY key)
        SELECT key, vid, value FROM v WHERE NOT (vid = 1200 AND key IN (SELECT c_custkey FROM customer))
        UNION ALL SELECT c_custkey, 1200, coalesce(f.value + 1, 0) FROM customer LEFT JOIN f ON f.key = c_custkey""",
)
def vmap_upsert_before(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return versioned.upsert_before(_versions(spark, d), ["key"], "vid", 1200, probes, {"value": F.lit(0).cast("long")}, {"value": F.col("value") + 1})


@query("vmap_insert", f"SELECT key, vid, value FROM {_V} WHERE NOT (key = 1 AND vid = 3) UNION ALL SELECT 1::BIGINT, 3, 99::BIGINT")
def vmap_insert(spark, d):
    v = _versions(spark, d)
    return versioned.insert(v, ["key"], "vid", spark.createDataFrame([(1, 3, 99)], v.schema))


@query("vmap_erase", f"SELECT key, vid, value FROM {_V} WHERE NOT (vid = 1200 AND key IN (SELECT c_custkey FROM customer))")
def vmap_erase(spark, d):
    return versioned.erase(_versions(spark, d), ["key"], "vid", 1200, table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


# secondary indexes

@query("index_lookup_by", "SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def index_lookup_by(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return indexed.lookup_by(c, ["c_custkey"], c_mktsegment="BUILDING").drop("c_mktsegment")


@query("index_slice_by", "SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def index_slice_by(spark, d):
    return indexed.slice_by(table(spark, d, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_nationkey")


@query("index_range_by", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 1000")
def index_range_by(spark, d):
    return indexed.range_by(table(spark, d, "customer"), "c_acctbal", 0, 1000).select("c_custkey", "c_acctbal")


@query("index_fold_slice_by", f"SELECT count(*) AS n, CAST(sum(CAST(c_acctbal AS {MONEY})) AS DOUBLE) AS total FROM customer WHERE c_nationkey = 3")
def index_fold_slice_by(spark, d):
    return indexed.fold_slice_by(table(spark, d, "customer"), {"c_nationkey": 3}, n=F.count(F.lit(1)), total=F.sum(F.col("c_acctbal").cast(MONEY)).cast("double"))


@query("index_fold_range_by", "SELECT count(*) AS n, max(c_custkey) AS most FROM customer WHERE c_acctbal BETWEEN 0 AND 1000")
def index_fold_range_by(spark, d):
    return indexed.fold_range_by(table(spark, d, "customer"), "c_acctbal", 0, 1000, n=F.count(F.lit(1)), most=F.max("c_custkey"))


@query("index_lookup_before_by", f"SELECT key, vid, value FROM (SELECT key, max(vid) AS vid, arg_max(value, vid) AS value FROM {_V} WHERE vid < 1200 GROUP BY key) WHERE key = 7")
def index_lookup_before_by(spark, d):
    return indexed.lookup_before_by(_versions(spark, d), ["key"], "vid", 1200, ["key"], key=7).select("key", "vid", "value")


@query("index_fold_slice_vid_by", f"SELECT count(*) AS n, max(vid) AS newest FROM (SELECT key, max(vid) AS vid FROM {_V} WHERE vid < 1200 GROUP BY key) WHERE key = 7")
def index_fold_slice_vid_by(spark, d):
    return indexed.fold_slice_vid_by(_versions(spark, d), ["key"], "vid", 1200, {"key": 7}, n=F.count(F.lit(1)), newest=F.max("vid"))


# tagged-union buffers: orders, lineitems and customers in the order of their keys

def _buffer(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return poly.union([("orders", o, "o_orderkey"), ("lineitem", l, "l_orderkey"), ("customer", c, "c_custkey")])


@query("poly_tags", "SELECT 0 AS tag, count(*) AS n FROM orders UNION ALL SELECT 1, count(*) FROM lineitem UNION ALL SELECT 2, count(*) FROM customer")
def poly_tags(spark, d):
    return poly.tag_counts(_buffer(spark, d))


@query("poly_variant", "SELECT l_orderkey AS seq, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def poly_variant(spark, d):
    return poly.variant(_buffer(spark, d), 1, "lineitem")


@query("poly_variant_range", "SELECT o_orderkey AS seq, o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def poly_variant_range(spark, d):
    return poly.variant_range(_buffer(spark, d), 0, "orders", 100, 400)


@query("poly_safe_at", "SELECT tag, sum(v)::BIGINT AS total FROM (SELECT 0 AS tag, o_custkey AS v FROM orders UNION ALL SELECT 1, -1 FROM lineitem UNION ALL SELECT 2, -1 FROM customer) GROUP BY tag")
def poly_safe_at(spark, d):
    b = _buffer(spark, d)
    return b.groupBy("tag").agg(F.sum(poly.safe_field(b, "orders", "o_custkey", F.lit(-1))).alias("total"))


@query("poly_append", "SELECT 0 AS tag, count(*) AS n FROM orders UNION ALL SELECT 1, count(*) FROM lineitem UNION ALL SELECT 2, count(*) FROM customer UNION ALL SELECT 3, count(*) FROM supplier")
def poly_append(spark, d):
    return poly.tag_counts(poly.append(_buffer(spark, d), 3, "supplier", table(spark, d, "supplier"), "s_suppkey"))


_TAGGED = "(SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS tag FROM events)"
_RUNS = f"""SELECT tag, min(seq) AS start, max(seq) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (ORDER BY seq) AS run FROM
   (SELECT *, CASE WHEN tag = lag(tag) OVER (ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM {_TAGGED})) GROUP BY tag, run"""


def _runs(spark, d):
    tag = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return poly.runs(table(spark, d, "events").select(F.col("event_id").alias("seq"), tag.alias("tag")), ["seq"])


@query("poly_runs", _RUNS)
def poly_runs(spark, d):
    return _runs(spark, d)


@query("poly_skip_all", f"""SELECT coalesce(max("end") + 1, 20) AS next FROM ({_RUNS}) WHERE tag = 2 AND start <= 20 AND "end" >= 20""")
def poly_skip_all(spark, d):
    return poly.skip_all(_runs(spark, d), 2, 20)


@query(
    "polyfile_batches",
    """WITH o AS (SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS tag FROM events),
       s AS (SELECT seq, tag, row_number() OVER (PARTITION BY tag ORDER BY seq) - 1 AS pos FROM o),
       r0 AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
       r1 AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
       SELECT seq, seq // 100 AS batch, 0 AS tag, r0.k FROM s JOIN r0 ON s.tag = 0 AND s.pos = r0.pos
       UNION ALL SELECT seq, seq // 100, 1, r1.k FROM s JOIN r1 ON s.tag = 1 AND s.pos = r1.pos""",
)
def polyfile_batches(spark, d):
    from sparkloom.operators.bag import with_position

    order = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1).alias("tag"))
    relations = [with_position(table(spark, d, t).select(F.col(k).alias("k")), ["k"]) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"))]
    return files.poly_file(relations, order, 100).select("seq", "batch", "tag", F.coalesce("r0.k", "r1.k").alias("k"))


@query(
    "filemux_order",
    """SELECT row_number() OVER (ORDER BY "order", channel) - 1 AS place, channel, "order" FROM (SELECT s_suppkey AS "order", 0 AS channel FROM supplier
       UNION ALL SELECT n_nationkey, 1 FROM nation UNION ALL SELECT r_regionkey, 2 FROM region)""",
)
def filemux_order(spark, d):
    from sparkloom.operators.bag import with_position

    channels = [table(spark, d, t).select(F.col(k).cast("long").alias("order")) for t, k in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"))]
    return with_position(files.file_mux(channels), ["order", "channel"], "place").select("place", "channel", "order")


@query("source_value", "SELECT 7 AS a, 'x' AS b")
def source_value(spark, d):
    return files.value(spark, (7, "x"), "a int, b string")


