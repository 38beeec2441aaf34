"""Collections on small literals: multiplicities, ends, absence, nulls and ties."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from sparkloom.operators import bag, indexed, joins, keyed, ordered, poly, sets, versioned


@pytest.fixture
def c5(spark):
    return spark.createDataFrame([(5,), (5,), (4,), (None,)], "x int")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, v) for v in t))


def test_bag(spark, c5):
    assert values(bag.size(c5)) == [(4,)]
    assert values(bag.erase(c5, (5,))) == [(None,), (4,), (5,)]
    assert values(bag.erase(c5, (9,))) == values(c5)
    assert values(bag.erase(c5, (None,))) == [(4,), (5,), (5,)]
    assert values(bag.update(c5, (5,), (6,))) == [(None,), (4,), (5,), (6,)]
    assert values(bag.update(c5, (9,), (6,))) == values(c5)
    assert values(bag.insert(c5, (5,), (1,))) == [(None,), (1,), (4,), (5,), (5,), (5,)]
    assert values(bag.clear(c5)) == []
    assert bag.peek(c5.dropna(), ["x"]).x == 4 and bag.peek(c5.limit(0), ["x"]) is None
    with pytest.raises(ValueError):
        bag.peek(c5, [])


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    placed = bag.with_position(df, ["k"])
    assert placed.where("k <> pos").count() == 0
    assert [r.k for r in bag.at(df, ["k"], 999).collect()] == [999] and bag.at(df, ["k"], 1000).collect() == []
    assert [r.k for r in bag.safe_at(df, ["k"], 1000, (-1,)).collect()] == [-1] and [r.k for r in bag.safe_at(df, ["k"], 3, (-1,)).collect()] == [3]
    first, second = bag.split(df.where("k < 7"), ["k"])
    assert [sorted(r.k for r in h.collect()) for h in (first, second)] == [[0, 1, 2], [3, 4, 5, 6]]
    assert bag.with_position(df.limit(0), ["k"]).collect() == []


def test_ordered_fold(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None), (None, 1, "z")], "k string, o int, v string")
    got = bag.fold_ordered(df, ["k"], ["o"], "v", "", lambda acc, v: acc + (v or "-"), "s", T.StringType())
    assert {(r.k, r.s) for r in got.collect()} == {("a", "xy"), ("b", "-"), (None, "z")}
    many = spark.range(50_000).select(F.lit(1).alias("k"), "id")
    assert bag.fold_ordered(many, ["k"], ["id"], "id", 0, lambda a, x: (a * 3 + int(x)) % 10007, "s", T.LongType()).count() == 1
    assert bag.fold_ordered(many.limit(0), ["k"], ["id"], "id", 0, lambda a, x: a, "s", T.LongType()).collect() == []


def test_sets(spark, c5):
    other = spark.createDataFrame([(4,), (None,), (7,)], "x int")
    assert values(sets.as_set(c5)) == [(None,), (4,), (5,)]
    assert values(sets.intersect(c5, other)) == [(None,), (4,)]
    assert values(sets.difference(c5, other)) == [(5,)]
    assert values(sets.union(c5, other)) == [(None,), (4,), (5,), (7,)]
    assert values(sets.insert(c5, (5,))) == [(None,), (4,), (5,)]
    assert values(sets.update(c5, (9,), (1,))) == [(None,), (4,), (5,)]
    assert values(sets.member(c5, other)) == [(None, True), (4, True), (7, False)]
    assert [r.is_subset for r in sets.is_subset_of(c5.limit(0), other).collect()] == [True]


def test_ordered(spark, c5):
    assert values(ordered.least(c5, "x")) == [(4,)] and values(ordered.greatest(c5, "x")) == [(5,)]
    assert values(ordered.least(c5.limit(0), "x")) == []
    assert values(ordered.lookup_lt(c5, "x", 4)) == [] and values(ordered.lookup_leq(c5, "x", 4)) == [(4,)]
    assert values(ordered.erase_before(c5, "x", 99)) == [] and values(ordered.erase_after(c5, "x", 4)) == [(4,)]


@pytest.mark.parametrize("mode, want", [("lt", [None, 10, 10, 30, None]), ("leq", [10, 10, 30, 30, None]), ("gt", [30, 30, None, None, None]), ("geq", [10, 30, 30, None, None])])
def test_nearest(spark, mode, want):
    table = spark.createDataFrame([(10, "a"), (10, "b"), (30, "c"), (None, "n")], "k int, v string")
    probes = spark.createDataFrame([(0, 10), (1, 20), (2, 30), (3, 40), (4, None)], "i int, p int")
    got = {r.i: (r.k, r.v) for r in ordered.nearest(probes, "p", table, "k", "v", mode).collect()}
    assert [got[i][0] for i in range(5)] == want
    assert all(v == {10: "a", 30: "c", None: None}[k] for k, v in got.values())


def test_keyed(spark):
    m = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "k int, v int")
    new = spark.createDataFrame([(2, 21), (3, 30)], "k int, v int")
    assert values(keyed.insert(m, new, ["k"])) == [(None, 5), (1, 10), (2, 21), (3, 30)]
    assert values(keyed.update_key(m, new, ["k"])) == [(None, 5), (1, 10), (2, 21)]
    assert values(keyed.erase_key(m, new, ["k"])) == [(None, 5), (1, 10)]
    assert values(keyed.insert_with(m, new, ["k"], v=F.sum)) == [(None, 5), (1, 10), (2, 41), (3, 30)]
    probes = spark.createDataFrame([(1,), (7,), (None,)], "k int")
    assert values(keyed.upsert_with(m, probes, ["k"], {"v": F.lit(0)}, {"v": F.col("a.v") + 1})) == [(None, 6), (1, 11), (2, 20), (7, 0)]
    writes = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 3)], "k int, v string, s int")
    assert values(keyed.project(writes, {"k": F.col("k")}, {"v": F.col("v")}, F.col("s"))) == [(1, "new"), (2, None)]


def test_versions(spark):
    v = spark.createDataFrame([(k, i, k * 100 + i) for k in range(3) for i in range(0, 20, 2)], "k int, vid int, v int")
    assert values(versioned.frontier(v, ["k"], "vid", 6)) == [(k, 4, k * 100 + 4) for k in range(3)]
    assert values(versioned.frontier(v, ["k"], "vid", 7)) == [(k, 6, k * 100 + 6) for k in range(3)]
    assert versioned.frontier(v, ["k"], "vid", 0).count() == 0
    kept = values(versioned.erase_all_before(v, ["k"], "vid", 15))
    assert [t[1] for t in kept if t[0] == 0] == [14, 16, 18]
    assert [r.v for r in versioned.update_after(v, "vid", 16, v=F.lit(0)).where("k = 1").orderBy("vid").collect()][-2:] == [116, 0]
    assert values(versioned.peek_now(v, ["k"], "vid").select("k", "vid", "v")) == [(0, 18, 18)]
    probes = spark.createDataFrame([(1, 5), (1, 0), (8, 5)], "k int, at int")
    assert values(versioned.lookup_before(v, ["k"], "vid", probes, "at")) == [(1, 0, None, None), (1, 5, 4, 104), (8, 5, None, None)]
    assert values(versioned.size(v, ["k"], "vid", 0)) == [(3,)] and values(versioned.total_size(v)) == [(30,)]


def test_index(spark):
    e = spark.createDataFrame([(1, "John", 30), (2, "alice", 40), (3, "bob", 40), (4, "charles", 45)], "key int, name string, age int")
    assert values(indexed.slice_by(e, age=40).select("key")) == [(2,), (3,)]
    assert values(indexed.lookup_by(e, ["key"], age=40).select("key")) == [(2,)] and indexed.lookup_by(e, ["key"], age=99).collect() == []
    assert values(indexed.fold_range_by(e, "age", 40, 45, n=F.count(F.lit(1)))) == [(3,)]


def test_poly(spark):
    tags = [0, 0, 1, 1, 1, 0, 2, 2]
    b = spark.createDataFrame(list(enumerate(tags)), "seq long, tag int")
    runs = poly.runs(b, ["seq"])
    assert sorted((r.start, r.end, r.tag, r.n) for r in runs.collect()) == [(0, 1, 0, 2), (2, 4, 1, 3), (5, 5, 0, 1), (6, 7, 2, 2)]
    assert [r.next for r in poly.skip_all(runs, 1, 3).collect()] == [5] and [r.next for r in poly.skip_all(runs, 1, 5).collect()] == [5]
    big = spark.range(20_000).select(F.col("id").alias("seq"), (F.col("id") / 700).cast("int").alias("tag"))
    assert {r.n for r in poly.runs(big, ["seq"]).where("tag < 28").collect()} == {700}


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_of_hot_keys(spark, strict):
    r = random.Random(5)
    key = lambda: r.choice(["hot"] * 8 + ["warm"] * 2 + [None, *"abcdef"])
    ls = [(i, key(), r.randint(0, 300) if r.random() < 0.95 else None) for i in range(1500)]
    rs = list({(k, t): (k, t, f"{k}{t}", i) for i, (k, t) in enumerate((key(), r.randint(0, 300)) for _ in range(400))}.values())
    left, right = spark.createDataFrame(ls, "id int, k string, t int").repartition(5), spark.createDataFrame(rs, "k string, at int, v string, ID int")
    got = joins.asof_join(left, right, ["k"], "t", "at", strict, share=0.05)
    assert got.columns == ["id", "k", "t", "at", "v", "ID_2"]
    want = {}
    for i, k, t in ls:
        fit = [x for x in rs if x[0] == k and k is not None and t is not None and (x[1] < t if strict else x[1] <= t)]
        want[i] = max(fit, key=lambda x: x[1])[1:] if fit else (None, None, None)
    assert {x.id: (x.at, x.v, x.ID_2) for x in got.collect()} == want
    plain = joins.asof_join(left, right, ["k"], "t", "at", strict, share=1.0)
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
    assert joins.asof_join(left.limit(0), right, ["k"], "t", "at").collect() == [] and joins.asof_join(left, right.limit(0), ["k"], "t", "at", strict, share=0.05).where("v IS NULL").count() == 1500


def test_running_folds_of_hot_keys(spark):
    r = random.Random(9)
    rows = [(r.choice(["hot"] * 9 + [None] * 4 + list("abcd")), i, r.choice([None, r.randint(-9, 9)])) for i in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    folds = {"n": F.count(F.lit(1)), "s": F.sum("v"), "lo": F.min("v"), "hi": F.max("v")}
    spread = bag.running(df, ["k"], ["o"], {"n": "sum", "s": "sum", "lo": "min", "hi": "max"}, 0.05, **folds)
    plain = bag.running(df, ["k"], ["o"], **folds)
    assert spread.columns == plain.columns and sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))
    assert bag.running(df.limit(0), ["k"], ["o"], {"n": "sum"}, n=F.count(F.lit(1))).collect() == []
    with pytest.raises(ValueError):
        bag.running(df, ["k"], ["o"], {"n": "avg"}, n=F.count(F.lit(1)))


def test_is_sorted(spark):
    df = spark.range(1000).repartition(7)
    assert ordered.is_sorted(df.orderBy("id"), F.col("id")) and not ordered.is_sorted(df, F.col("id"))
    assert not ordered.is_sorted(df.orderBy(F.desc("id")), F.col("id")) and ordered.is_sorted(df.limit(0), F.col("id"))


def test_joins(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("c", 1, "z"), (None, 1, "n")], "k string, rt int, v string")
    assert values(joins.asof_join(left, right, ["k"], "t", "rt").select("k", "t", "v")) == [(None, 5, None), ("a", 1, "x"), ("a", 5, "y"), ("b", 5, None)]
    assert values(joins.asof_join(left, right, ["k"], "t", "rt", True).select("k", "t", "v")) == [(None, 5, None), ("a", 1, None), ("a", 5, "x"), ("b", 5, None)]
    on = (F.col("l.k") == F.col("r.k")) & (F.col("l.t") > F.col("r.rt"))
    assert joins.theta_join(left.alias("l"), right.alias("r"), on).count() == 1
    assert joins.broadcast_join(left, right, "k", most=1).count() == 4
    big = spark.range(3).select(F.lit("x" * 100).alias("a"), "id")
    assert not joins.fits_broadcast(big, 200) and joins.fits_broadcast(big, 1000) and joins.fits_broadcast(big.limit(0), 0)
    assert joins.fits_broadcast(right) and joins.theta_join(left.alias("l"), right.alias("r"), F.col("l.t") > F.col("r.rt")).count() == 9
    with pytest.raises(ValueError):
        joins.theta_join(left.alias("l"), right.alias("r"), F.col("l.t") > F.col("r.rt"), most=1)
    assert joins.theta_join(left.alias("l"), right.alias("r"), F.col("l.t") > F.col("r.rt"), most=1, product=True).count() == 9
    intervals = spark.createDataFrame([(0, 10, "i"), (5, 5, "j"), (9, 3, "never"), (None, 4, "n")], "lo int, hi int, name string")
    assert values(ordered.pairs_between(left, "t", intervals, "lo", "hi", 4.0).select("k", "t", "name")) == sorted([("a", 5, "i"), ("a", 5, "j"), ("a", 1, "i"), ("b", 5, "i"), ("b", 5, "j"), (None, 5, "i"), (None, 5, "j")], key=lambda t: tuple((v is not None, v) for v in t))
