"""Queries of join strategies, distributed helpers, scalar functions, vectors and bit sets."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from sparkloom.functions import arrays as A, scalar as S
from sparkloom.operators import joins
from sparkloom.operators.heavy import heavy_keys, skew_aggregate, skew_join
from sparkloom.plans.registry import query
from sparkloom.sources import files
from sparkloom.tables import table

MONEY = "decimal(18,4)"


@query("join_hash", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def join_hash(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return joins.hash_join(l, o, ["k"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("join_broadcast", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_broadcast(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return joins.broadcast_join(c, n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("join_skew", "SELECT e.event_type, count(*) AS n, sum(x.n)::BIGINT AS total FROM events e JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) x ON e.event_type = x.event_type GROUP BY ALL")
def join_skew(spark, d):
    e = table(spark, d, "events").select("event_type")
    x = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("x"))
    return skew_join(e, x, ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("join_left_nonmatch", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority LIKE '1%') ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def join_left_nonmatch(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority LIKE '1%'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_full_outer", "SELECT count(*) AS n, count(c_custkey) AS l, count(s_suppkey) AS r FROM customer FULL JOIN supplier ON c_custkey + 50 = s_suppkey")
def join_full_outer(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") + 50 == F.col("s_suppkey"), "full_outer")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("l"), F.count("s_suppkey").alias("r"))


@query("join_semi", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, d):
    f = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(f, F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


for _strict in (False, True):

    def _asof(spark, d, strict=_strict):
        e = table(spark, d, "events")
        clicks = e.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
        buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        return joins.asof_join(buys, clicks.withColumnRenamed("ts", "click_ts"), ["user_id"], "ts", "click_ts", strict).select("event_id", "click_id")

    query(
        "join_asof_strict" if _strict else "join_asof",
        f"""WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
            SELECT event_id, arg_max(click_id, c.ts) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b LEFT JOIN c
            ON c.user_id = b.user_id AND c.ts {'<' if _strict else '<='} b.ts GROUP BY event_id""",
    )(_asof)


@query(
    "multiway_gmr",
    """SELECT n_name, sum(c.m * o.m)::BIGINT AS mult FROM (SELECT c_nationkey, c_custkey, count(*) AS m FROM customer GROUP BY ALL) c
       JOIN (SELECT o_custkey, count(*) AS m FROM orders GROUP BY ALL) o ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""",
)
def multiway_gmr(spark, d):
    c = joins.with_multiplicity(table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")))
    o = joins.with_multiplicity(table(spark, d, "orders").select(F.col("o_custkey").alias("cust")))
    n = joins.with_multiplicity(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"))
    return joins.collapse(joins.multiway([o, c, n], [["cust"], ["nation"]]).select("n_name", "mult"))


@query("gmr_collapse", "SELECT o_custkey, sum(m)::BIGINT AS mult FROM (SELECT o_custkey, 1 AS m FROM orders UNION ALL SELECT c_custkey, -1 FROM customer) GROUP BY o_custkey HAVING sum(m) <> 0")
def gmr_collapse(spark, d):
    plus = table(spark, d, "orders").select("o_custkey", F.lit(1).cast("long").alias("mult"))
    minus = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("mult"))
    return joins.collapse(plus.unionByName(minus))


@query("preagg_sum_count", f"SELECT c_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def preagg_sum_count(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    aggs = {"n": F.count(F.lit(1)), "total": F.sum(F.col("o_totalprice").cast(MONEY)).cast("double")}
    return joins.preaggregated_join(o, table(spark, d, "customer").select("c_custkey"), ["c_custkey"], aggs)


@query("stats_collections", "SELECT 'orders' AS collection, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def stats_collections(spark, d):
    return joins.collection_statistics({n: table(spark, d, n) for n in ("orders", "part")})


@query("stats_per_partition", "SELECT count(*) AS n, 8::BIGINT AS partitions FROM lineitem")
def stats_per_partition(spark, d):
    rows = joins.partition_by_key(table(spark, d, "lineitem").select("l_orderkey"), ["l_orderkey"], 8)
    return joins.partition_statistics(rows).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partitions"))


@query("partition_by_key", "SELECT l_orderkey, count(*) AS n, 1::BIGINT AS places FROM lineitem GROUP BY l_orderkey")
def partition_by_key(spark, d):
    """All rows of a key are in one place."""
    rows = joins.partition_by_key(table(spark, d, "lineitem").select("l_orderkey"), ["l_orderkey"], 8)
    placed = rows.withColumn("part", F.spark_partition_id())
    return placed.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("places"))


@query("partition_round_robin", "SELECT count(*) AS n, 8::BIGINT AS partitions, true AS even FROM lineitem")
def partition_round_robin(spark, d):
    """Partitions differ by no more rows than there were partitions before."""
    rows = table(spark, d, "lineitem").select("l_orderkey")
    stats = joins.partition_statistics(joins.partition_round_robin(rows, 8))
    return stats.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partitions"), (F.max("n") - F.min("n") <= rows.rdd.getNumPartitions()).alias("even"))


@query("key_histogram", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def key_histogram(spark, d):
    return joins.key_histogram(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("heavy_hitters", "SELECT event_type FROM events GROUP BY ALL HAVING count(*) >= 0.1 * (SELECT count(*) FROM events)")
def heavy_hitters(spark, d):
    e = table(spark, d, "events").select("event_type")
    counts = skew_aggregate(e, ["event_type"], {"n": F.count(F.lit(1))}, {"n": F.sum}, heavy=heavy_keys(e, ["event_type"], 0.1))
    return counts.where(F.col("n") >= 0.1 * e.agg(F.count(F.lit(1)).alias("total")).scalar()).select("event_type")


# scalar functions

@query(
    "fn_strings",
    """SELECT p_partkey, list_extract(string_split(p_name, ' '), 1) AS head, length(p_name) - length(replace(p_name, 'a', '')) AS n_a, substring(p_name, 3, 4) AS part,
       left(p_name, 5) AS start, reverse(p_name) AS back, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS words_back,
       CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS cmp, upper(p_name) AS up, lower(p_type) AS low, ascii(p_name) AS code, chr(65 + p_size % 20) AS char FROM part""",
)
def fn_strings(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", S.take_until(n, " ").alias("head"), S.count_char(n, "a").cast("long").alias("n_a"), S.slice_string(n, 2, 6).alias("part"), S.prefix(n, 5).alias("start"), S.reverse_characters(n).alias("back"),
        S.reverse_words(n).alias("words_back"), S.strcomp(n, F.col("p_type")).alias("cmp"), F.upper(n).alias("up"), F.lower("p_type").alias("low"), S.ord_of(n).alias("code"), S.char_of(F.col("p_size") % 20 + 65).alias("char"),
    )


@query(
    "fn_dates",
    """SELECT o_orderkey, year(o_orderdate)::INT * 10000 + month(o_orderdate)::INT * 100 + day(o_orderdate)::INT AS n, strftime(o_orderdate, '%Y-%m-%d') AS text, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m,
       day(o_orderdate)::INT AS d, sign(datediff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)))::INT AS cmp FROM orders""",
)
def fn_dates(spark, d):
    n = S.date_to_int(F.col("o_orderdate"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", n.alias("n"))
    c = F.col("n")
    return rows.select(
        "o_orderkey", S.text_to_date_int(S.date_int_to_text(c)).alias("n"), S.date_int_to_text(c).alias("text"), S.date_part("year", c).alias("y"), S.date_part("month", c).alias("m"),
        S.date_part("day", c).alias("d"), S.compare_date(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("cmp"),
    )


@query(
    "fn_math",
    """SELECT event_id, round(ln(value + 1), 6) AS l, round(exp(value / 1000), 6) AS e, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(tanh(value / 1000), 6) AS th, round(sqrt(value), 6) AS sq, abs(-value) AS a,
       trunc(value)::BIGINT AS t, greatest(value, 50.0) AS hi, least(value, 50.0) AS lo, (event_id - 500) // 7 + (CASE WHEN event_id < 500 AND (event_id - 500) % 7 <> 0 AND (event_id - 500) // 7 * 7 < event_id - 500 THEN 0 ELSE 0 END) AS q,
       format('{:.6f}', value) AS txt FROM events""",
)
def fn_math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(F.log(v + 1), 6).alias("l"), F.round(F.exp(v / 1000), 6).alias("e"), F.round(F.sin(v), 6).alias("s"), F.round(F.cos(v), 6).alias("c"), F.round(F.tanh(v / 1000), 6).alias("th"),
        F.round(F.sqrt(v), 6).alias("sq"), F.abs(-v).alias("a"), S.truncate(v).alias("t"), S.greatest(v, F.lit(50.0)).alias("hi"), S.least(v, F.lit(50.0)).alias("lo"),
        S.int_div(F.col("event_id") - 500, F.lit(7)).alias("q"), S.real_to_text(v).alias("txt"),
    )


@query("fn_regex", "SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_full_match(p_brand, 'Brand#[0-9]+')::INT AS is_brand, regexp_full_match(p_brand, 'Brand')::INT AS not_full FROM part")
def fn_regex(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(S.regex_matches(F.col("p_name"), "[aeiou]")).cast("long").alias("vowels"), S.regex_full_match(F.col("p_brand"), "Brand#[0-9]+").alias("is_brand"), S.regex_full_match(F.col("p_brand"), "Brand").alias("not_full"))


@query("fn_json", """SELECT r_regionkey, concat('{"r_regionkey":', r_regionkey, ',"r_name":"', r_name, '"}') AS js FROM region""")
def fn_json(spark, d):
    return table(spark, d, "region").select("r_regionkey", S.to_json(F.struct("r_regionkey", "r_name")).alias("js"))


@query("fn_json_extract", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def fn_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("fn_parse_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def fn_parse_csv(spark, d):
    line = F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    parsed = S.from_csv(line, "n_nationkey int, n_name string, n_regionkey int", "|")
    return table(spark, d, "nation").select(parsed.alias("r")).select("r.*")


@query("fn_clock", "SELECT n_nationkey, (n_nationkey * 2 + (n_nationkey::BIGINT * 900000000 + 500000000) // 1000000000)::BIGINT AS sec, ((n_nationkey::BIGINT * 900000000 + 500000000) % 1000000000)::BIGINT AS nsec FROM nation")
def fn_clock(spark, d):
    k = F.col("n_nationkey").cast("long")
    a, b = F.struct((k * 2).alias("sec"), (k * 900000000).alias("nsec")), F.struct(F.lit(0).cast("long").alias("sec"), F.lit(500000000).cast("long").alias("nsec"))
    return table(spark, d, "nation").select("n_nationkey", a.alias("a"), b.alias("b")).select("n_nationkey", S.add_time(F.col("a"), F.col("b")).alias("s")).select("n_nationkey", "s.*")


@query("fn_clock_sub", "SELECT n_nationkey, (n_nationkey - 1)::BIGINT AS sec, 999999999::BIGINT AS nsec FROM nation")
def fn_clock_sub(spark, d):
    k = F.col("n_nationkey").cast("long")
    a, b = F.struct(k.alias("sec"), F.lit(0).cast("long").alias("nsec")), F.struct(F.lit(0).cast("long").alias("sec"), F.lit(1).cast("long").alias("nsec"))
    return table(spark, d, "nation").select("n_nationkey", a.alias("a"), b.alias("b")).select("n_nationkey", S.sub_time(F.col("a"), F.col("b")).alias("s")).select("n_nationkey", "s.*")


@query("fn_range", "SELECT range AS i FROM range(1000)")
def fn_range(spark, d):
    return spark.range(1000).withColumnRenamed("id", "i")


@query("fn_seeded", None)
def fn_seeded(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.seeded_int(100, F.col("o_orderkey")).alias("n"), S.seeded_fraction(F.col("o_orderkey")).alias("f"), S.hash_of(F.col("o_orderkey")).alias("h"))


@query("fn_sql_functions", "SELECT p_partkey, left(p_name, instr(p_name || ' ', ' ') - 1) AS head, substring(p_name, 2, 3) AS cut FROM part")
def fn_sql_functions(spark: SparkSession, d):
    S.register(spark)
    return table(spark, d, "part").select("p_partkey", F.expr("take_until(p_name, ' ')").alias("head"), F.expr("slice_string(p_name, 1, 4)").alias("cut"))


# arrays, vectors and bit sets

_EMB = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def _emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query("vec_dot", f"SELECT vec_id, round(list_dot_product(e, e), 6) AS dot FROM {_EMB}")
def vec_dot(spark, d):
    return _emb(spark, d).select("vec_id", F.round(A.dot(F.col("e"), F.col("e")), 6).alias("dot"))


@query("vec_distance", f"SELECT vec_id, round(list_distance(e, list_transform(e, lambda x: x * 2 + 1)), 6) AS dist FROM {_EMB}")
def vec_distance(spark, d):
    return _emb(spark, d).select("vec_id", F.round(A.distance(F.col("e"), F.transform("e", lambda x: x * 2 + 1)), 6).alias("dist"))


@query("vec_add_sub_scale", f"SELECT vec_id, round(list_sum([(e[i] + e[i] * 3) * i for i in range(1, 65)]), 5) AS a, round(list_sum([(e[i] - e[i] * 3) * i for i in range(1, 65)]), 5) AS s, round(list_sum([e[i] * 3 * i for i in range(1, 65)]), 5) AS c FROM {_EMB}")
def vec_add_sub_scale(spark, d):
    """Every element of the results counts, weighted by its place."""
    e, three = F.col("e"), A.scale(F.col("e"), 3.0)
    weighted = lambda v: F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5)
    return _emb(spark, d).select("vec_id", weighted(A.add(e, three)).alias("a"), weighted(A.sub(e, three)).alias("s"), weighted(three).alias("c"))


@query("vec_sum_by_label", f"SELECT label, i::INT AS i, round(sum(CAST(v AS DECIMAL(28,10)))::DOUBLE, 5) AS total FROM (SELECT label, unnest(e) AS v, unnest(range(0, len(e))) AS i FROM {_EMB}) GROUP BY label, i")
def vec_sum_by_label(spark, d):
    exploded = _emb(spark, d).select("label", F.posexplode("e").alias("i", "v"))
    return exploded.groupBy("label", "i").agg(F.round(F.sum(F.col("v").cast("decimal(28,10)")).cast("double"), 5).alias("total"))


@query("vec_text", "SELECT r_regionkey, concat('[', r_regionkey, ',', r_regionkey + 1, ']') AS t FROM region")
def vec_text(spark, d):
    k = F.col("r_regionkey")
    return table(spark, d, "region").select("r_regionkey", A.to_text(F.array(k, k + 1)).alias("t"))




def _arr(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long"), F.lit(7).cast("long")).alias("a"))


@query(
    "array_access",
    """SELECT c_custkey AS k, c_custkey AS first, -1::BIGINT AS none, c_nationkey::BIGINT AS old, 9::BIGINT AS new, concat(c_custkey, ',', c_nationkey + 1, ',7') AS updated, concat(c_custkey, ',5,', c_nationkey, ',7') AS inserted,
       concat(c_custkey, ',7') AS erased, '0,0,0' AS zeros FROM customer""",
)
def array_access(spark, d):
    a, text = F.col("a"), lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    s = A.swap(a, 1, F.lit(9).cast("long"))
    return _arr(spark, d).select(
        "k", A.at(a, 0).alias("first"), A.safe_at(a, 5, F.lit(-1).cast("long")).alias("none"), s["old"].alias("old"), A.at(s["value"], 1).alias("new"), text(A.update_at(a, 1, lambda x: x + 1)).alias("updated"),
        text(A.insert_at(a, 1, F.lit(5).cast("long"))).alias("inserted"), text(A.erase_at(a, 1)["value"]).alias("erased"), text(A.set_all(a, F.lit(0))).alias("zeros"),
    )


@query("array_fill_zip", "SELECT n_nationkey, '0,2,4' AS by, '3,3' AS filled, concat(n_nationkey, ',', n_nationkey + 2, ',', n_nationkey + 4) AS zipped FROM nation")
def array_fill_zip(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    evens = A.fill_by(3, lambda i: i * 2)
    return table(spark, d, "nation").select("n_nationkey", text(evens).alias("by"), text(A.fill(2, F.lit(3))).alias("filled"), text(A.zip_by(A.fill(3, F.col("n_nationkey")), evens, lambda x, y: x + y)).alias("zipped"))


@query("array_shuffle", "SELECT c_custkey AS k, array_to_string(list_sort([c_custkey, c_nationkey, 7]), ',') AS members, true AS again FROM customer")
def array_shuffle(spark, d):
    """The same members in an order that the seed decides."""
    s = A.shuffled(F.col("a"), 5)
    return _arr(spark, d).select("k", F.array_join(F.transform(F.array_sort(s), lambda x: x.cast("string")), ",").alias("members"), (s == A.shuffled(F.col("a"), 5)).alias("again"))


@query(
    "bitset_ops",
    """SELECT n_regionkey AS k, len(list_distinct(list(n_nationkey) || [99])) AS inserted, len(list_filter(list_distinct(list(n_nationkey)), lambda x: x <> 3)) AS erased, list_contains(list(n_nationkey), 3) AS has3, sum(n_nationkey)::BIGINT AS total
       FROM nation GROUP BY n_regionkey""",
)
def bitset_ops(spark, d):
    b = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(A.bits(F.collect_set("n_nationkey")).alias("b"))
    c = F.col("b")
    return b.select(
        "k", F.size(A.insert_bit(c, 99)).cast("long").alias("inserted"), F.size(A.erase_bit(c, 3)).cast("long").alias("erased"), A.member_bit(c, 3).alias("has3"),
        A.fold_bits(c, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
    )


@query("vector_loader", "SELECT vec_id, round(list_sum([e[i] * i for i in range(1, 65)]), 5) AS weighted, label::DOUBLE AS label FROM " + _EMB)
def vector_loader(spark, d):
    e = _emb(spark, d)
    lines = e.select("vec_id", F.concat_ws(",", F.transform("e", lambda x: x.cast("string")), F.col("label").cast("string")).alias("value"))
    features, label = files.parse_labelled_vector(F.col("value"), 64)
    weighted = F.aggregate(F.transform(features, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return lines.select("vec_id", F.round(weighted, 5).alias("weighted"), label.alias("label"))


@query("graph_loader", "SELECT o_custkey AS src, count(DISTINCT o_orderkey) AS degree FROM orders GROUP BY ALL")
def graph_loader(spark, d):
    o = table(spark, d, "orders")
    # a line per order: source and one edge; the loader takes any number of edges a line
    lines = o.select(F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("value"))
    return files.load_graph(lines).groupBy("src").agg(F.count_distinct("dst").alias("degree"))
