"""Evaluation passages in documents."""

import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import leakage
from sparkloom.llm.leakage import block_candidates, block_tables, find_leaks, fingerprints, shingle_similarity, words


def _brute(docs, items, n=10):
    runs = defaultdict(set)
    for i, *passages in items:
        for p in passages:
            w = words(p)
            for k in range(len(w) - n + 1):
                runs[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(i, d) for i in runs.get(tuple(w[k : k + n]), ())}
    return out


def _text(r, n):
    return " ".join(r.choice("the map of node peer rows keys a_b x9 lädt écrase and drops unless".split()) for _ in range(n))


def _data():
    r = random.Random(7)
    items = [(i, _text(r, r.choice([4, 9, 10, 30])), _text(r, 15)) for i in range(60)] + [(60, None, ""), (61, "one two three four five six seven eight nine ten", None), (61, "one two three four five six seven eight nine ten", None)]
    docs = []
    for d in range(300):
        t = _text(r, r.randint(0, 60))
        if r.random() < 0.4:
            w = words(r.choice(items[:60])[r.choice([1, 2])])
            a = r.randint(0, max(0, len(w) - 10))
            piece = w[a : a + r.choice([9, 10, 12])]
            t += r.choice([" ", "\n"]) + r.choice([" ", " - ", "\n\n", "… "]).join(x.upper() if r.random() < 0.2 else x for x in piece) + " " + _text(r, 5)
        docs.append((d, t))
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in "one two three four five six seven eight nine ten")
    return docs + [(900, None), (901, ""), (902, wide), (902, wide), (903, "x one, two: three four five (six) seven eight nine; ten."), (904, "w " * 300_000)], items


@pytest.mark.parametrize("block", [leakage.ITEM_WINDOWS, 200])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "ITEM_WINDOWS", block)
    docs, items = _data()
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc int, text string, item int").repartition(4)
    i = spark.createDataFrame([(*x, 0) for x in items], "item int, q string, a string, doc int")
    got = [tuple(x) for x in find_leaks(d, "doc", "text", i, "item", ["q", "a"], exact=True).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(docs, items)
    assert {(61, 902), (61, 903)} <= set(got)


def test_near_passages_are_found(spark):
    w = [f"w{i}" for i in range(40)]
    near = w[:18] + ["changed"] + w[19:]
    d = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(w)), (3, " ".join(reversed(w)))], "doc int, text string")
    i = spark.createDataFrame([(7, " ".join(w))], "item int, q string")
    got = {tuple(x) for x in find_leaks(d, "doc", "text", i, "item", ["q"], window=40, similarity=0.7, exact=False, radius=16).collect()}
    assert got == {(7, 1), (7, 2)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc int, text string")
    i = spark.createDataFrame([], "item int, q string")
    full = spark.createDataFrame([(1, _text(random.Random(1), 20))], "doc int, text string")
    assert find_leaks(d, "doc", "text", i, "item", ["q"]).collect() == []
    assert find_leaks(full, "doc", "text", i, "item", ["q"]).collect() == []


def test_blocks_miss_nothing_within_the_radius():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 200).astype(np.uint64)
    probes = base.copy()
    for k in range(3):
        probes ^= np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)
    left, right = block_candidates(probes, base, block_tables(base, 3), 3)
    assert set(zip(range(200), range(200))) <= set(zip(left.tolist(), right.tolist()))


def test_fingerprints_depend_on_the_window_alone():
    r = np.random.default_rng(2)
    h = r.integers(0, 2**63, 500_000 // 5).astype(np.uint64)
    all_ = fingerprints(h, 10)
    for i in (0, 1, 65_530, 65_536, 70_000, len(h) - 10):
        assert all_[i] == fingerprints(h[i : i + 10], 10)[0]
    assert len(fingerprints(h[:9], 10)) == 0 and len(fingerprints(h[:3], 1)) == 3


def test_similarity_counts_repeats():
    a = np.array([[1, 1, 1, 2]])
    assert shingle_similarity(a, a, 1)[0] == 1
    assert shingle_similarity(a, np.array([[1, 2, 2, 2]]), 1)[0] == pytest.approx(2 / 6)
    assert shingle_similarity(a, np.array([[3, 1, 1, 2]]), 2)[0] == pytest.approx(2 / 4)
