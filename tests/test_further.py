"""Handles, flat buffers, cursors, join selection, keyed state and sockets on small inputs."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.operators import indexed, joins, poly
from sparkloom.plans import ml
from sparkloom.plans.sqlfront import run_script
from sparkloom.sources import files
from sparkloom.streaming import core


def test_handles(spark, tmp_path):
    at = str(tmp_path / "h")
    w = files.open_file(spark, at, "json", "k int, s string", "w")
    w.block = 2
    for row in ((1, "a"), (2, None), (3, "c")):
        w.do_write(*row)
    assert w.has_write()
    w.close()
    assert not w.has_write()
    with pytest.raises(ValueError):
        w.do_write(4, "d")
    r = files.open_file(spark, at, "json", "k int, s string")
    assert r.has_read() and len(r.do_block_read(2)) == 2 and len(r.do_block_read(2)) == 1 and r.do_block_read(2) == [] and not r.has_read()
    with pytest.raises(StopIteration):
        r.do_read()
    one = files.open_value(spark, (7,), "x int")
    assert one.do_read().x == 7
    one.close()
    assert not one.has_read()
    with pytest.raises(ValueError):
        files.open_file(spark, at, "json", None, "a")


def test_flat_buffers(spark):
    schema = "i int, s string, d decimal(10,2), t timestamp_ntz, a array<struct<x: double>>, m map<string,int>, b binary"
    rows = [(1, "ä", decimal.Decimal("1.50"), datetime.datetime(2024, 1, 2, 3, 4, 5), [(1.5,), (None,)], {"k": 1}, bytearray(b"\x00\xff")), (None,) * 7]
    df = spark.createDataFrame(rows * 3, schema)
    back = files.unpack(files.repack(df), df.schema)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert files.unpack(files.repack(df.limit(0)), df.schema).collect() == []


def test_cursor(spark):
    b = spark.createDataFrame([("a", i, i % 2) for i in range(9)] + [(None, 0, 1), ("b", 5, 0)], "g string, seq long, tag int").repartition(3)
    step = lambda tag, place, n: 3 if n == 0 else 0 if n == 2 else tag + 1
    got = sorted((r.g or "", r.place, r.seq, r.tag) for r in poly.traverse(b, ["g"], ["seq"], step).collect())
    assert got == [("", 0, 0, 1), ("a", 0, 0, 0), ("a", 3, 3, 1), ("a", 5, 5, 1), ("b", 0, 5, 0)]
    assert [r.place for r in poly.traverse(b.where("g = 'a'"), ["g"], ["seq"], lambda *_: 1, 7, 99).collect()] == [7, 8]
    assert poly.traverse(b.limit(0), ["g"], ["seq"], step).collect() == []


def test_join_selection(spark):
    left = spark.createDataFrame([("hot",)] * 90 + [("c",)] * 10 + [(None,)], "k string")
    right = spark.createDataFrame([("hot", 1), ("c", 2), (None, 3)], "k string, v int")
    for how, n in (("inner", 100), ("left", 101)):
        assert joins.select_join(left, right, ["k"], how).count() == n
    plan = joins.plan_lines(joins.select_join(left, right, ["k"]))
    assert any("BroadcastHashJoin" in r.text for r in plan.collect())
    a, b, c = (spark.createDataFrame([(1, 2)], s) for s in ("x int, mult int", "y int, mult int", "x int, mult int"))
    with pytest.raises(ValueError):
        joins.ordered_multiway([a, b, c])
    probes = spark.createDataFrame([("c", 1), ("zz", 2), (None, 3)], "k string, i int")
    assert sorted((r.i, r.n) for r in indexed.fold_slices(left, probes, ["k"], n=F.count(F.lit(1))).fillna(0).collect()) == [(1, 10), (2, 0), (3, 1)]


def test_keyed_state_over_batches(spark, tmp_path):
    at = tmp_path / "t.parquet"
    rows = [(i, i % 3, float(i) if i % 4 else None) for i in range(40)]
    for n in range(4):  # four files in order, one a batch
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "at long, k int, put double").coalesce(1).write.mode("append").parquet(str(at))
    stream = lambda: core.read_stream(spark, str(tmp_path), "t", 1)
    got = {(r.k, r.at): r.value for r in core.run_to_end(core.key_value_store(stream(), "k", "at", "put")).collect()}
    held, want = {}, {}
    for i, k, put in rows:
        if put is None:
            want[k, i] = held.get(k)
        else:
            held[k] = put
    assert got == want
    once = core.run_to_end(core.on_count(stream(), "k", 13)).collect()
    assert sorted((r.k, r.fired) for r in once) == [(0, 1), (1, 1), (2, 1)] and core.run_to_end(core.on_count(stream(), "k", 15)).count() == 0
    each = core.run_to_end(core.on_count(stream(), "k", 5, True)).collect()
    assert sorted((r.k, r.fired) for r in each) == [(k, f) for k in range(3) for f in (1, 2)]


def test_sockets_and_stopping(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    spark.createDataFrame([(f"line {i} é",) for i in range(50)] + [(None,)], "value string").repartition(3).write.parquet(at)
    with core.LineServer() as server:
        core.run_to_socket(core.read_stream(spark, str(tmp_path), "t", 1), server.host, server.port)
        assert sorted(server.lines()) == sorted(f"line {i} é" for i in range(50))
    seen = []
    q = core.read_stream(spark, str(tmp_path), "t").writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: seen.append(b.count())).start()
    core.stop_when(q, lambda: bool(seen))
    assert not q.isActive and sum(seen) == 51


def test_rejected_statements(spark):
    """A column beside an aggregate without GROUP BY, and statements other than CREATE TABLE and SELECT, are refused."""
    r = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(Exception, match="MISSING_GROUP_BY"):
        run_script(spark, "create table R(a int, b int); select a, sum(b) as s from R", {"R": r})
    with pytest.raises(ValueError):
        run_script(spark, "create table R(a int, b int); insert into R values (1, 2)", {"R": r})


def test_dates_and_words(spark):
    df = spark.createDataFrame([("03.02.1998", 1), ("31.02.1998", 2), (None, 3)], "s string, i int")
    got = [r.p for r in df.select(S.parse_date(F.col("s"), "dd.MM.yyyy").alias("p"), "i").orderBy("i").collect()]
    assert tuple(got[0]) == (1998, 2, 3) and got[1:] == [None, None]
    words = df.select(S.seeded_word(5, F.col("i")).alias("w")).collect()
    assert len({r.w for r in words}) == 3 and df.select(S.seeded_binomial(0, 0.5, F.col("i")).alias("b")).first().b == 0
    packed = df.select(S.parse_packed(S.pack_record(F.struct("s", "i")), "s string, i int").alias("r"))
    assert packed.select("r.*").collect() == df.collect()


def test_autoencoder(spark):
    rows = [(i, [float(i % 5) / 5, float(i % 3) / 3, float(i % 5) / 5 - float(i % 3) / 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    weights, losses = ml.autoencoder(df, "id", "v", 3, 2, 30, 0.2, shards=2, batch=16)
    assert losses[-1] < losses[0] / 3 and [w.shape for w in weights] == [(3, 2), (2, 3)]
    again = ml.autoencoder(df.repartition(5), "id", "v", 3, 2, 30, 0.2, shards=2, batch=16)[1]
    assert again == losses and ml.autoencoder(df.limit(0), "id", "v", 3, 2, 2)[1] == []
