"""Differences between two copies."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.tablediff import _matrix_pairs, _same_py, _unpaired, best_pairs, diff_copies, least_differing_pairs, min_cost_pairs

SCHEMA = "k string, a string, x double, other int"


def _diff(spark, left, right, **kw):
    l, r = (spark.createDataFrame([(*t, 0) for t in rows], SCHEMA) for rows in (left, right))
    return sorted((d.k, d.field, d.left_value, d.right_value, d.copies) for d in diff_copies(l, r, ["k"], ["a", "x"], **kw).collect())


def test_pairs_are_the_cheapest():
    r = random.Random(5)
    for _ in range(300):
        n, m = r.randint(1, 5), r.randint(1, 5)
        cost = [[r.randint(0, 4) for _ in range(m)] for _ in range(n)]
        pairs = min_cost_pairs(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        c = cost if n <= m else [list(x) for x in zip(*cost)]
        best = min(sum(c[i][p[i]] for i in range(len(c))) for p in permutations(range(len(c[0])), len(c)))
        assert sum(cost[i][j] for i, j in pairs) == best


def test_fields_and_sides(spark):
    nan, inf = float("nan"), float("inf")
    left = [("1", "a", 1.0), ("2", "b", 2.0), ("3", None, nan), ("4", "d", 0.0), ("5", "e", inf), (" 6 ", " f", 1.0)]
    right = [("1", "a", 1.005), ("3", "c", nan), ("4", "d", -0.0), ("5", "e", inf), ("6", "f", 1.0), ("7", "g", None)]
    got = _diff(spark, left, right, trim=("k", "a"), tolerance={"x": 0.01}, distinct=True)
    assert got == [("2", "left_only", None, None, 1), ("3", "a", None, "c", 1), ("3", "x", "NaN", "NaN", 1), ("5", "x", "Infinity", "Infinity", 1), ("7", "right_only", None, None, 1)]
    exact = _diff(spark, left[2:4], right[1:3])
    assert exact == [("3", "a", None, "c", 1)]  # without a tolerance equal values are equal, not-a-number too


def test_copies(spark):
    left = [("1", "a", 1.0)] * 3 + [("1", "b", 2.0)]
    right = [("1", "a", 1.0)] + [("1", "b", 5.0)]
    assert _diff(spark, left, right) == [("1", "left_only_extra", None, None, 2), ("1", "x", "2.0", "5.0", 1)]
    assert _diff(spark, left, right, distinct=True) == [("1", "x", "2.0", "5.0", 1)]
    assert _diff(spark, [], right) == [("1", "right_only", None, None, 2)]
    assert _diff(spark, [], []) == []


def test_null_keys_match(spark):
    l = spark.createDataFrame([(None, "a", 1.0, 0)], SCHEMA)
    r = spark.createDataFrame([(None, "b", 1.0, 0)], SCHEMA)
    assert [(d.k, d.field) for d in diff_copies(l, r, ["k"], ["a", "x"]).collect()] == [(None, "a")]


def test_hot_key_in_rounds(spark):
    n = 300
    left = [("hot", f"v{i}", float(i)) for i in range(n)] + [("cold", "a", 1.0)]
    right = [("hot", f"v{i}", float(i) + 1000) for i in range(n - 10)] + [("cold", "b", 1.0)]
    got = _diff(spark, left, right)
    assert ("cold", "a", "a", "b", 1) in got
    assert ("hot", "left_only_extra", None, None, 10) in got
    assert sum(c for k, f, *_, c in got if k == "hot" and f == "x") == n - 10
    assert not [g for g in got if g[0] == "hot" and g[1] == "a"]  # rows that agree in one field were paired by it


def test_network_pairs_are_the_cheapest():
    r = random.Random(3)
    nan, inf = float("nan"), float("inf")
    for _ in range(200):
        tol = r.choice([[None, None, 0.01], [None, 0.01], [0.01, 0.5], [0.01]])
        values = {None: [None, "a", "b", "c"], 0.01: [None, 0, 0.004, 0.009, 0.012, 0.018, 1.0, nan, inf], 0.5: [None, 0.1, 0.4, 0.7, 1.1]}
        a, b = ([tuple(r.choice(values[t]) for t in tol) for _ in range(r.randint(0, 8))] for _ in range(2))
        cost = [[sum(not _same_py(v, w, t) for v, w, t in zip(x, y, tol)) for y in b] for x in a]
        pairs = least_differing_pairs(a, b, tol)
        assert len(pairs) == min(len(a), len(b)) == len({i for i, *_ in pairs}) == len({j for _, j, _ in pairs})
        assert sum(cost[i][j] for i, j, _ in pairs) == sum(cost[i][j] for i, j in min_cost_pairs(cost))


def _total(pairs, a, b, tol):
    return sum(n * sum(not _same_py(v, w, t) for v, w, t in zip(a[i], b[j], tol)) for i, j, n in pairs)


@pytest.mark.parametrize("size", [1, 2, 7, 30, 63, 64, 65, 66, 100, 200, 300])
def test_one_cost_at_every_size(size):
    """By a network, a matrix of lists and a matrix of arrays, the numbers of copies included."""
    r = random.Random(size)
    tol = [None, None, 0.01, None]
    row = lambda: (r.choice("abcdefg"), r.randint(0, size // 2), r.choice([None, r.randint(0, 9) * 0.006, float("nan")]), r.choice("xyz"))
    a, b = [row() for _ in range(size)], [row() for _ in range(max(1, size - r.randint(0, 5)))]
    ones = [1] * len(a), [1] * len(b)
    cost = [[sum(not _same_py(v, w, t) for v, w, t in zip(x, y, tol)) for y in b] for x in a]
    want = sum(cost[i][j] for i, j in min_cost_pairs(cost))
    assert sum(cost[i][j] for i, j in min_cost_pairs(np.array(cost))) == want
    for way in (least_differing_pairs, _matrix_pairs, best_pairs):
        pairs = way(a, b, tol, *ones)
        assert sum(n for *_, n in pairs) == min(len(a), len(b)) and _total(pairs, a, b, tol) == want
    copies = [r.randint(1, 4) for _ in a], [r.randint(1, 4) for _ in b]
    flow, matrix = least_differing_pairs(a, b, tol, *copies), _matrix_pairs(a, b, tol, *copies)
    assert _total(flow, a, b, tol) == _total(matrix, a, b, tol) and sum(n for *_, n in flow) == sum(n for *_, n in matrix) == min(map(sum, copies))
    assert all(x >= 0 for side in _unpaired(flow, *copies) for x in side)


@pytest.mark.parametrize("n, least", [(64, 128), (65, 130)])
def test_partners_that_differ_in_two_fields(spark, n, least):
    schema = "k string, a int, b int, c int, d int"
    left = spark.createDataFrame([("hot", i, i, i, i) for i in range(n)], schema)
    right = spark.createDataFrame([("hot", i, i, -1 - i, -1 - i) for i in reversed(range(n))], schema)
    assert diff_copies(left, right, ["k"], ["a", "b", "c", "d"]).agg(F.sum("copies")).first()[0] == least


def test_many_copies_and_many_fields(spark):
    """A million copies of one row are one row with a number; sets of 24 fields are too many for a network."""
    left = spark.range(1_000_000).select(F.lit("k").alias("k"), F.lit("old").alias("a"), F.lit(1.0).alias("x"))
    right = spark.range(999_990).select(F.lit("k").alias("k"), F.lit("new").alias("a"), F.lit(1.0).alias("x"))
    got = sorted((d.field, d.left_value, d.right_value, d.copies) for d in diff_copies(left, right, ["k"], ["a", "x"]).collect())
    assert got == [("a", "old", "new", 999_990), ("left_only_extra", None, None, 10)]
    names = [f"f{i}" for i in range(24)]
    rows = [tuple(i * 100 + c for c in range(24)) for i in range(80)]
    l = spark.createDataFrame([("k", *t) for t in rows], ["k", *names])
    r = spark.createDataFrame([("k", *t[:-2], -1, -2) for t in reversed(rows)], ["k", *names])
    assert diff_copies(l, r, ["k"], names).agg(F.sum("copies")).first()[0] == 160


def test_hot_key_differing_in_two_fields(spark):
    """Each row's counterpart differs in two fields, or in one and by rounding noise; the others agree with it nowhere."""
    n = 300
    schema = "k string, a string, b long, x double, c string"
    left = [("hot", f"v{i}", i, float(i), f"d{i}") for i in range(n)]
    right = [("hot", f"w{i}", -1 - i, i + 0.004, f"d{i}") if i % 2 else ("hot", f"v{i}", i, i - 0.004, f"e{i}") for i in range(n)]
    l, r = (spark.createDataFrame(rows, schema) for rows in (left, right[::-1]))
    got = {(d.field, d.left_value, d.right_value) for d in diff_copies(l, r, ["k"], ["a", "b", "x", "c"], tolerance={"x": 0.01}, distinct=True).collect()}
    want = {w for i in range(n) for w in ([("a", f"v{i}", f"w{i}"), ("b", str(i), str(-1 - i))] if i % 2 else [("c", f"d{i}", f"e{i}")])}
    assert got == want
