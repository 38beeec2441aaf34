"""Collections as objects."""

from pyspark.sql import functions as F

from sparkloom.collections import Collection, Map, MultiIndexBag, PolyBuffer, Seq, Set, Sorted, SortedMap, SortedSet, VMap


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_multiplicities(spark):
    df = spark.createDataFrame([(5,), (5,), (4,)], "x int")
    assert Collection(df).insert((5,)).size() == 4 and Collection(df).erase((5,)).size() == 2
    assert Set(df).size() == 2 and Set(df).insert((5,), (6,)).size() == 3 and Set(df).combine(Set(df)).size() == 2
    assert rows(Sorted(df, "x").min()) == [(4,)] and rows(SortedSet(df, "x").filter_gt(4).df) == [(5,)]
    assert Collection(df).map(y=F.col("x") * 2).filter(F.col("y") > 8).fold(s=F.sum("y")).s == 20
    assert Set(df).is_subset_of(Set(df)) and rows(Set(df).difference(Set(df.where("x = 4"))).df) == [(5,)]
    s = Seq(df, ["x"])
    assert s.peek().x == 4 and rows(s.pop().df) == [(5,), (5,)] and [h.size() for h in s.split()] == [1, 2]
    assert Collection(df).clear().size() == 0


def test_maps(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    m = SortedMap(df, "k")
    assert rows(m.insert((2, 21), (3, 30)).df) == [(1, 10), (2, 21), (3, 30)]
    assert rows(m.lookup_lt(2)) == [(1, 10)] and m.between(2, 9).size() == 1 and isinstance(m.between(2, 9), Map)
    left, gone = Map(df, ["k"]).erase_with(spark.createDataFrame([(1,)], "k int"))
    assert rows(left.df) == [(2, 20)] and rows(gone) == [(1, 10)]
    assert rows(Map(df, ["k"]).insert_with(df, v=F.sum).df) == [(1, 20), (2, 40)]
    v = VMap(spark.createDataFrame([(1, 0, 5), (1, 2, 7), (2, 4, 9)], "k int, vid int, x int"), ["k"])
    assert rows(v.at(2).df) == [(1, 0, 5)] and v.size(2) == 1 and v.total_size() == 3
    assert rows(v.update_after(0, x=F.lit(1)).at(9).df) == [(1, 2, 1), (2, 4, 1)]
    assert v.erase_all_before(3).total_size() == 2 and rows(v.insert((1, 2, 8)).at(3).df) == [(1, 2, 8)]
    e = MultiIndexBag(spark.createDataFrame([(1, "a", 40), (2, "b", 40)], "id int, name string, age int"))
    assert e.slice_by(age=40).size() == 2 and e.fold_range_by("age", 0, 50, n=F.count(F.lit(1))).n == 2


def test_buffers(spark):
    a = spark.createDataFrame([(0, 1), (2, 3)], "s int, a int")
    b = spark.createDataFrame([(1, "x")], "s int, b string")
    p = PolyBuffer.of([("a", a, "s"), ("b", b, "s")])
    assert rows(p.variant("b")) == [(1, 1, "x")] and rows(p.tags()) == [(0, 2), (1, 1)]
    assert p.skip_all("b", 1) == 2 and p.append("c", b, "s").size() == 4
    assert rows(p.split_many(2).select("seq", "chunk")) == [(0, 0), (1, 0), (2, 1)] and p.byte_size() > 0
