"""Skewed keys and feature maintenance."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.operators.features import apply_deltas, feature_table, later_arrivals, signed, type_features
from sparkloom.operators.heavy import heavy_keys, skew_aggregate, skew_join
from sparkloom.plans import p_general


def test_heavy_keys_and_aggregate(spark):
    r = random.Random(2)
    rows = [("hot", None, r.randint(0, 9)) for _ in range(3000)] + [(f"k{i % 2000}", "x", i) for i in range(6000)] + [(None, None, 1)] * 500
    df = spark.createDataFrame(rows, "a string, b string, v int").repartition(6)
    heavy = {(h.a, h.b) for h in heavy_keys(df, ["a", "b"], 0.05).collect()}
    assert heavy == {("hot", None), (None, None)}
    got = {(x.a, x.b): (x.n, x.s, x.m) for x in skew_aggregate(df, ["a", "b"], {"n": F.count(F.lit(1)), "s": F.sum("v"), "m": F.max("v")}, {"n": F.sum, "s": F.sum, "m": F.max}).collect()}
    want = {}
    for a, b, v in rows:
        n, s, m = want.get((a, b), (0, 0, v))
        want[a, b] = (n + 1, s + v, max(m, v))
    assert got == want
    assert skew_aggregate(df.limit(0), ["a"], {"n": F.count(F.lit(1))}, {"n": F.sum}).collect() == []


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(1000)] + [(f"k{i}", i) for i in range(500)] + [(None, 1)] * 50, "k string, v int")
    right = spark.createDataFrame([("hot", 1, 1), ("hot", 2, 2), ("k7", 3, 3), (None, 4, 4)], "k string, v int, w int")
    key = lambda r: (r.k or "", r.v, r.w or 0)
    for how in ("inner", "left"):
        plain = left.join(right.select("k", "w"), "k", how)
        for most in (200_000, 1):
            got = skew_join(left, right, ["k"], how, most=most)
            assert got.columns == ["k", "v", "v_r", "w"]
            assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))


EVENTS = "e string, k string, s string, t int"


def _brute(events, kinds):
    out = {}
    for e in {x[0] for x in events}:
        row = {}
        for k in kinds:
            mine = [x for x in events if x[0] == e and x[1] == k]
            row[k] = (len(mine), max((x[3] for x in mine if x[3] is not None), default=None), len({x[2] for x in mine if x[2] is not None}))
        out[e] = row
    return out


def _wide(df, kinds):
    return {r[0]: {k: tuple(r[1 + 3 * i : 4 + 3 * i]) for i, k in enumerate(kinds)} for r in df.collect()}


def test_deltas_equal_recomputation(spark):
    r = random.Random(4)
    kinds = ["a", "b", "never"]
    make = lambda n: [(r.choice(["x", "y", None]), r.choice(["a", "b", "c", None]), r.choice(["s1", "s2", None]), r.choice([1, 2, 3, 4, None])) for _ in range(n)]
    first, second = make(300), make(60)
    gone = r.sample(first, 120)
    left = list((Counter(first) + Counter(second) - Counter(gone)).elements())
    df = lambda rows: spark.createDataFrame(rows, EVENTS)
    args = (["e"], "k", "s", "t")
    state = apply_deltas(None, signed(df(first), 1), *args)
    batch = signed(df(second), 1).unionByName(signed(df(gone), -1))
    cells = apply_deltas(state, batch, *args, log=signed(df(first), 1))
    assert _wide(feature_table(cells, ["e"], "k", "s", kinds), kinds) == _brute(left, kinds)
    once = apply_deltas(None, signed(df(first), 1).unionByName(batch), *args)
    assert _wide(feature_table(once, ["e"], "k", "s", kinds), kinds) == _brute(left, kinds)
    totals = {(x.e, x.k): x.total for x in type_features(cells, ["e"], "k", "s").collect()}
    for e in ("x", "y", None):
        for k in ("a", "b", "c", None):
            assert totals.get((e, k), 0) == sum(x[3] or 0 for x in left if x[0] == e and x[1] == k)


def test_all_taken_back(spark):
    df = spark.createDataFrame([("x", "a", "s", 1)] * 3, EVENTS)
    args = (["e"], "k", "s", "t")
    state = apply_deltas(None, signed(df, 1), *args)
    assert apply_deltas(state, signed(df, -1), *args, log=signed(df, 1)).collect() == []
    assert feature_table(apply_deltas(None, signed(df.limit(0), 1), *args), ["e"], "k", "s", ["a"]).collect() == []
    clash = feature_table(state.withColumnRenamed("e", "a__count"), ["a__count"], "k", "s", ["a"])
    assert clash.columns == ["a__count", "a__count_2", "a__last_time", "a__sources"]


def test_later_arrivals(spark):
    rows = [(1, 5, "a"), (1, 3, "b"), (1, 3, "b"), (2, None, "c"), (2, 1, "c"), (3, 1, None), (None, 1, "z"), (None, 1, "z")] + [(9, 7, "h")] * 400 + [(9, 6, "h")] * 2
    df = spark.createDataFrame(rows, "id int, t int, s string")
    for share in (0.005, 1.0):  # with and without the way for hot identities
        got = Counter()
        for r in later_arrivals(df, ["id"], ["t", "s"], share).collect():
            got[r.id, r.t, r.s] += r.copies
        assert got == Counter({(1, 3, "b"): 1, (1, 5, "a"): 1, (2, 1, "c"): 1, (None, 1, "z"): 1, (9, 6, "h"): 1, (9, 7, "h"): 400})


def test_maintained_query_carries_a_state(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    rows = [(r.randint(1, 4), r.randint(1, 12), r.choice("xy"), r.choice("ab"), r.choice(["s1", "s2", None]), r.choice([1, 2, 3, None])) for _ in range(300)]
    spark.createDataFrame(rows, "job_id int, mess_id int, dest_peer string, trigger string, source_peer string, time int").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([("a",), ("b",)], "trigger string").write.parquet(f"{tmp_path}/trigger_list.parquet")
    calls = []
    monkeypatch.setattr(p_general, "apply_deltas", lambda state, deltas, *a, **kw: calls.append((state, deltas, kw)) or apply_deltas(state, deltas, *a, **kw))
    got = {t.pop("dest_peer"): t for t in (x.asDict() for x in p_general.p6_maintained(spark, str(tmp_path)).collect())}
    state, batch, kw = calls[-1]
    assert state.count() and {s.sign > 0 for s in batch.select("sign").distinct().collect()} == {True, False} and kw["log"].count()
    low = lambda v: (v is not None, v or 0)
    first = {}
    for row in sorted(rows, key=lambda x: (low(x[5]), x[3], (x[4] is not None, x[4] or ""))):
        first.setdefault(row[:3], row)
    for e in "xy":
        for k in "ab":
            mine = [x for x in first.values() if x[2:4] == (e, k)]
            want = (len(mine), max((x[5] for x in mine if x[5] is not None), default=None), len({x[4] for x in mine} - {None}))
            assert tuple(got[e][f"{k}__{v}"] for v in ("count", "last_time", "sources")) == want
