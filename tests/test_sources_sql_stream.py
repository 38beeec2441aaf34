"""Files, SQL scripts, scalar functions, learning and streams."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.plans import graph, ml
from sparkloom.plans.sqlfront import run_script, statements
from sparkloom.sources import files
from sparkloom.streaming import core


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, s string")
    for fmt in ("csv", "psv", "tsv", "json", "parquet", "orc"):
        at = str(tmp_path / fmt)
        files.write(df, at, fmt)
        assert sorted((r.k, r.s) for r in files.read(spark, at, fmt, "k int, s string").collect()) == [(1, "a|b"), (2, None)], fmt
    paths = []
    for i, lines in enumerate((["1,x", "4,y"], ["2,p", "3,q"])):
        p = tmp_path / f"{i}.csv"
        p.write_text("\n".join(lines) + "\n")
        paths.append(str(p))
    seq = files.file_sequence(spark, paths, "csv", "order int, v string")
    assert sorted((r.file_no, r.order) for r in seq.collect()) == [(0, 1), (0, 4), (1, 2), (1, 3)]
    mux = files.file_mux_sequence(spark, [[paths[0]], [paths[1]]], "csv", "order int, v string")
    assert [r.v for r in mux.collect()] == ["x", "p", "q", "y"]
    assert files.line_count(spark, paths[0]) == 2
    assert files.read(spark, paths[0], "raw").count() == 1 and files.read(spark, paths[0], "text").count() == 2
    with pytest.raises(ValueError):
        files.read(spark, paths[0], "csv")
    files.gather(df, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    g = spark.createDataFrame([("1,2,3",), ("4",), ("",), (None,)], "value string")
    assert sorted((r.src, r.dst or 0) for r in files.load_graph(g).collect()) == [(1, 2), (1, 3), (4, 0)]


def test_loaders(spark, tmp_path):
    (tmp_path / "r.csv").write_text("url1,10,3\nurl2,5,1\n")
    (tmp_path / "v.csv").write_text("1.2.3.4,url1,1980-04-01,0.5,ua,DEU,de,word,7\n")
    r = files.load_rankings(spark, str(tmp_path / "r.csv"), "pageURL", "pageRank")
    assert sorted(tuple(x) for x in r.collect()) == [("url1", 10), ("url2", 5)]
    v = files.load_uservisits(spark, str(tmp_path / "v.csv"))
    assert v.join(r, v.destURL == r.pageURL).select("sourceIP", "pageRank", "adRevenue").first()[:] == ("1.2.3.4", 10, 0.5)
    line = spark.createDataFrame([("1.5,2,7",)], "l string")
    features, label = files.parse_labelled_vector(F.col("l"), 2)
    assert line.select(features.alias("f"), label.alias("y")).first()[:] == ([1.5, 2.0], 7.0)


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    for name in ("bucketed_a", "bucketed_b"):
        files.write_bucketed(left, name, ["k"], 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_scripts(spark):
    r = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert statements("select ';' ; -- no;\n select 2") == ["select ';'", "select 2"]
    assert [x.v for x in run_script(spark, "create table R(a int, b int); select top 1 a * b as v from R order by v desc;", {"R": r}).collect()] == [12]
    for bad in ("create table R(a int, z int); select 1", "create table R(a text); select 1", "drop table R", "create table Q(a int); select 1", "create table R(a int)"):
        with pytest.raises(ValueError):
            run_script(spark, bad, {"R": r})


def test_scalars(spark):
    df = spark.createDataFrame([("a,b", 19980231, -7, 2)], "s string, n int, a int, b int")
    row = df.select(
        S.slice_string(F.col("s"), -3, 2).alias("x"), S.slice_string(F.col("s"), 2, 1).alias("y"), S.text_to_date_int(F.lit("1998-02-31")).alias("z"), S.text_to_date_int(F.lit("1998-02-03")).alias("d"),
        S.date_part("month", F.col("n")).alias("m"), S.int_div(F.col("a"), F.col("b")).alias("q"), S.regex_full_match(F.col("s"), "a|b").alias("f"), S.count_char(F.col("s"), ",").alias("c"),
    ).first()
    assert tuple(row) == ("a,", "", None, 19980203, 2, -3, 0, 1)
    with pytest.raises(Exception, match="division by zero"):
        df.select(S.int_div(F.col("a"), F.lit(0))).collect()
    with pytest.raises(Exception, match="not a date"):
        df.select(S.parse_sql_date(F.col("s"))).collect()


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (1, 3), (4, None)], "src int, dst int")
    ranks = {r.vertex: r.rank for r in graph.pagerank(edges, 20).collect()}
    state = dict.fromkeys((1, 2, 3, 4), 0.25)
    out = {1: [2, 3], 2: [3], 3: [1], 4: []}
    for _ in range(20):
        new = dict.fromkeys(state, 0.0)
        for v, x in state.items():
            p = 0.15 / 4 + 0.85 * x
            for w in out[v] or state:
                new[w] += p / (len(out[v]) or 4)
        state = new
    assert ranks == pytest.approx(state) and graph.pagerank(edges.limit(0)).collect() == []


def test_learning(spark):
    rows = [(i, [float(i % 2 * 10 + i % 3), 1.0], float(i % 2 * 2 - 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y double")
    means = sorted(ml.kmeans(df, "id", "v", 2, 5))
    assert means[0] == pytest.approx([1.0, 1.0]) and means[1] == pytest.approx([11.0, 1.0])
    w, losses = ml.sgd_svm(df, "id", "v", "y", 2, 10, shards=3, batch=7)
    assert len(losses) == 10 and losses[-1] < losses[0] and sum((w[0] * v[0] + w[1]) * y > 0 for _, v, y in rows) > 54
    assert ml.sgd_svm(df.repartition(7, "y"), "id", "v", "y", 2, 10, shards=3, batch=7)[0] == w  # whatever the partitioning
    p = [0.0, 0.0]
    for k in range(3):  # by hand: shards of every third row, steps of 7 rows
        ends = []
        for shard in range(3):
            q, mine = list(p), [r for r in rows if r[0] % 3 == shard]
            for lo in range(0, len(mine), 7):
                part = mine[lo : lo + 7]
                short = [(v, y) for _, v, y in part if y * (q[0] * v[0] + q[1] * v[1]) < 1]
                q = [q[i] - 0.1 * 0.95**k * (0.001 * q[i] - sum(y * v[i] for v, y in short) / len(part)) for i in range(2)]
            ends.append(q)
        p = [sum(q[i] for q in ends) / 3 for i in range(2)]
    assert ml.sgd_svm(df, "id", "v", "y", 2, 3, shards=3, batch=7)[0] == pytest.approx(p)
    assert ml.kmeans(df.limit(0), "id", "v") == [] and ml.sgd_svm(df.limit(0), "id", "v", "y", 2, 2)[0] == [0.0, 0.0]


def test_streams(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int").repartition(5).write.parquet(at)
    stream = lambda: core.read_stream(spark, str(tmp_path), "t", 2)  # noqa: E731 - several batches
    got = core.run_to_end(core.running_aggregate(stream(), ["k"], n=F.count(F.lit(1)), s=F.sum("v")), "update", ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(k, 10, sum(range(k, 30, 3))) for k in range(3)]
    assert core.run_to_end(core.deduplicate(stream().select("k"), ["k"])).count() == 3
    seen = []
    assert core.run_to_end(stream(), on_batch=lambda b, n: seen.append(n)).count() == 30 and len(seen) == 3
    assert sorted(r.n for r in core.run_to_end(stream().groupBy("k").agg(F.count(F.lit(1)).alias("n")), "complete").collect()) == [10, 10, 10]
    with pytest.raises(ValueError):
        core.run_to_end(stream(), "update")
