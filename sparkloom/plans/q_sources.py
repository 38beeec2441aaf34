"""Queries that write tables, in the folder executors share, and read them back through each source, reader and loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import arrays as A, scalar as S
from sparkloom.operators.bag import with_position
from sparkloom.operators.sizes import measured_bytes
from sparkloom.plans.registry import query
from sparkloom.sources import files
from sparkloom.streaming import core
from sparkloom.tables import table

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"
_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


for _fmt in ("csv", "psv", "tsv", "json", "parquet", "orc"):

    @query(f"file_{_fmt}", _CUSTOMER)
    def _round_trip(spark: SparkSession, d: str, fmt: str = _fmt) -> DataFrame:
        at = files.scratch(spark)
        files.write(_customer(spark, d), at, fmt)
        return files.read(spark, at, fmt, _SCHEMA)


@query("file_text", "SELECT c_name AS value FROM customer")
def file_text(spark, d):
    at = files.scratch(spark)
    files.write(_customer(spark, d).select("c_name"), at, "text")
    return files.read(spark, at, "text")


@query("file_raw", "SELECT sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer")
def file_raw(spark, d):
    at = files.scratch(spark)
    files.write(_customer(spark, d).select("c_name"), at, "text")
    return files.read(spark, at, "raw").agg(F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query("file_line_count", "SELECT count(*) AS n FROM customer")
def file_line_count(spark, d):
    at = files.scratch(spark)
    files.write(_customer(spark, d), at, "csv")
    return spark.range(1).select(F.lit(files.line_count(spark, at)).cast("long").alias("n"))


def _parts(spark: SparkSession, d: str, n: int) -> list[str]:
    """Customers in n files by remainder of the key."""
    at = files.scratch(spark)
    for i in range(n):
        files.write(_customer(spark, d).where(F.col("c_custkey") % n == i).select(F.col("c_custkey").alias("order"), "c_name"), f"{at}/{i}", "csv")
    return [f"{at}/{i}" for i in range(n)]


@query("file_sequence", "SELECT (c_custkey % 3)::INT AS file_no, c_custkey AS \"order\", c_name FROM customer")
def file_sequence(spark, d):
    return files.file_sequence(spark, _parts(spark, d, 3), "csv", "order bigint, c_name string")


@query("file_mux_sequence", "SELECT (c_custkey % 4 % 2)::INT AS channel, c_custkey AS \"order\", c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def file_mux_sequence(spark, d):
    """Two channels of two files each, merged by order; the places in the merge are numbered."""
    p = _parts(spark, d, 4)
    merged = files.file_mux_sequence(spark, [[p[0], p[2]], [p[1], p[3]]], "csv", "order bigint, c_name string")
    return with_position(merged, ["order"], "place")


@query("file_relation_batches", """SELECT o_orderkey AS seq, o_orderkey // 100 AS batch, CASE WHEN o_orderkey % 3 = 0 THEN 'customer' ELSE 'part' END AS relation,
    CASE WHEN o_orderkey % 3 = 0 THEN (SELECT c_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) c WHERE c.pos = k)
    ELSE (SELECT p_name FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) p WHERE p.pos = k) END AS name
    FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 3 = 0 ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderkey <= 300)""")
def file_relation_batches(spark, d):
    """All relations of an order table in batches: each entry takes the next row of its relation."""
    relations = {
        "customer": with_position(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), ["c_custkey"], "pos").drop("c_custkey"),
        "part": with_position(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), ["p_partkey"], "pos").drop("p_partkey"),
    }
    order = table(spark, d, "orders").where("o_orderkey <= 300").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "customer").otherwise("part").alias("relation"))
    rows = files.relation_batches(relations, order, 100)
    name = F.coalesce("customer.name", "part.name")
    return rows.select("seq", "batch", F.when(F.col("customer").isNotNull(), "customer").otherwise("part").alias("relation"), name.alias("name"))


@query("file_gather", "SELECT 1::BIGINT AS files, count(*) AS n FROM customer")
def file_gather(spark, d):
    """Everything in one file."""
    at = files.scratch(spark)
    files.gather(_customer(spark, d), at, "psv")
    return files.read(spark, at, "psv", _SCHEMA).select("_metadata.file_path").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("n"))


@query("file_save_load", _CUSTOMER)
def file_save_load(spark, d):
    at = files.scratch(spark)
    files.save(_customer(spark, d), at)
    return files.load(spark, at)


@query("file_repack", _CUSTOMER)
def file_repack(spark, d):
    df = _customer(spark, d)
    return files.unpack(files.repack(df), df.schema)


@query("file_partitioned", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey = 7 GROUP BY ALL")
def file_partitioned(spark, d):
    """A table divided by key; a filter on it reads one folder."""
    at = files.scratch(spark)
    files.write(_customer(spark, d), at, "parquet", ["c_nationkey"])
    return files.load(spark, at).where("c_nationkey = 7").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("file_bucketed_join", "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def file_bucketed_join(spark, d):
    at = files.scratch(spark)
    names = [f"{n}_{at[-12:]}" for n in ("bucketed_customer", "bucketed_orders")]
    files.write_bucketed(table(spark, d, "customer"), names[0], ["c_custkey"], 8, f"{at}/c")
    files.write_bucketed(table(spark, d, "orders"), names[1], ["o_custkey"], 8, f"{at}/o")
    return spark.table(names[1]).join(spark.table(names[0]).hint("merge"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("file_byte_size", "SELECT sum(8 + 8 + strlen(c_name))::BIGINT AS bytes FROM customer")
def file_byte_size(spark, d):
    return spark.range(1).select(F.lit(measured_bytes(_customer(spark, d).select("c_name", "c_nationkey"))).cast("long").alias("bytes"))


@query("file_handles", "SELECT n_nationkey, n_name, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS block FROM nation")
def file_handles(spark, d):
    """Elements written through a handle and read in blocks through another; the table is fixed and tiny, as control files are."""
    at = files.scratch(spark)
    out = files.open_file(spark, at, "csv", "n_nationkey int, n_name string", "w")
    rows = files.Reader(table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))
    while rows.has_read() and out.has_write():
        out.do_write(*rows.do_read())
    out.close()
    back = files.Reader(files.read(spark, at, "csv", "n_nationkey int, n_name string").orderBy("n_nationkey"))
    made, block = [], 0
    while part := back.do_block_read(10):
        made += [(*r, block) for r in part]
        block += 1
    back.close()
    return spark.createDataFrame(made, "n_nationkey int, n_name string, block long")


@query("file_rankings", "SELECT p_name AS pageURL, p_size AS pageRank FROM part")
def file_rankings(spark, d):
    at = files.scratch(spark)
    files.write(table(spark, d, "part").select("p_name", "p_size", F.lit(1)), at, "csv")
    return files.load_rankings(spark, at, "pageURL", "pageRank")


@query("file_uservisits", "SELECT c_name AS sourceIP, DATE '1996-01-01' + (c_custkey % 700)::INT AS visitDate, c_acctbal AS adRevenue FROM customer")
def file_uservisits(spark, d):
    at = files.scratch(spark)
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    files.write(table(spark, d, "customer").select("c_name", F.lit("url"), day, "c_acctbal", *[F.lit(x) for x in ("ua", "DEU", "de", "word")], F.lit(1)), at, "csv")
    return files.load_uservisits(spark, at, "sourceIP", "visitDate", "adRevenue")


@query("file_strings", "SELECT c_custkey, c_name FROM customer")
def file_strings(spark, d):
    """A line parsed into a record: delimited, and packed."""
    rows = _customer(spark, d).select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("line"), S.pack_record(F.struct("c_custkey", "c_name")).alias("packed"))
    psv, packed = S.parse_psv(F.col("line"), "c_custkey bigint, c_name string"), S.parse_packed(F.col("packed"), "c_custkey bigint, c_name string")
    return rows.select(psv.alias("a"), packed.alias("b")).where("a = b").select("a.*")


@query("file_vectors", "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, label::DOUBLE AS label FROM embeddings")
def file_vectors(spark, d):
    """All numbers of vectors with labels, through a text file."""
    at = files.scratch(spark)
    e = table(spark, d, "embeddings").select("vec_id", F.concat_ws(",", F.transform("embedding", lambda x: x.cast("double").cast("string")), F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("line"))
    files.write(e.select("line"), at, "text")
    features, label = files.parse_labelled_vector(F.col("value"), 64)
    key = F.element_at(files.parse_vector(F.col("value")), -1).cast("long")
    rows = files.read(spark, at, "text").select(key.alias("vec_id"), features.alias("f"), label.alias("label"))
    return rows.select("vec_id", A.array_size(F.col("f")).alias("n"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "label")


@query("stream_socket_sink", "SELECT n_nationkey, n_name FROM nation")
def stream_socket_sink(spark, d):
    """A stream into a TCP server, which here stands at the driver and keeps what comes."""
    with core.LineServer(spark.conf.get("spark.driver.host")) as server:
        core.run_to_socket(core.read_stream(spark, d, "nation").select(F.to_csv(F.struct("n_nationkey", "n_name")).alias("value")), server.host, server.port)
        lines = server.lines()
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return rows.select(S.from_csv(F.col("value"), "n_nationkey int, n_name string").alias("r")).select("r.*")
