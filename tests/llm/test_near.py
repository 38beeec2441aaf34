"""Near copies of whole passages."""

import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import leakage
from sparkloom.llm.leakage import words
from sparkloom.llm.near import find_near_passages

VOCABULARY = [f"w{i}" for i in range(400)]


def _similarity(a, b, k=5):
    k = min(k, len(a), len(b)) if min(len(a), len(b)) < k else k
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def _best(text, passage):
    """Greatest similarity of a window as long as the passage, or of the whole text if it is shorter."""
    a, b = words(text), words(passage)
    if not a or not b or len(a) < len(b) and (len(a) < 5 and len(b) >= 5):
        return 0.0
    return max(_similarity(a[s : s + len(b)], b) for s in range(max(1, len(a) - len(b) + 1)))


def _edited(r, w, times):
    w = list(w)
    for _ in range(times):
        k = r.randrange(len(w))
        match r.choice("sdi"):
            case "s":
                w[k] = r.choice(VOCABULARY)
            case "d":
                del w[k]
            case "i":
                w.insert(k, r.choice(VOCABULARY))
    return w


def _data(edits):
    r = random.Random(edits)
    text = lambda n: [VOCABULARY[min(int(r.expovariate(0.02)), 399)] for _ in range(n)]
    items = [(i, " ".join(text(r.choice([3, 5, 20, 30, 45, 60, 61, 90]))), " ".join(text(r.randint(20, 60))) if i % 3 else None) for i in range(40)]
    docs = []
    for d in range(150):
        w = words(r.choice(items)[1])
        near = _edited(r, w, edits if len(w) > 10 else 0)
        docs.append((d, " ".join(text(r.randint(0, 40)) + near + text(r.randint(0, 40)))))
    return items, docs


@pytest.mark.parametrize("edits", [0, 1, 2])
@pytest.mark.parametrize("block", [leakage.ITEM_WINDOWS, 2000])
def test_against_brute_force(spark, monkeypatch, edits, block):
    monkeypatch.setattr(leakage, "ITEM_WINDOWS", block)
    items, docs = _data(edits)
    want = {(i, d) for i, *passages in items for d, t in docs for p in passages if p and set(words(p)) & set(words(t)) and _best(t, p) >= 0.8}
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc int, text string, item int").repartition(3)
    i = spark.createDataFrame([(*x, 0) for x in [*items, items[0]]], "item int, q string, a string, doc int")
    rows = [tuple(x) for x in find_near_passages(d, "doc", "text", i, "item", ["q", "a"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want
    assert len(rows) == len(want) if not edits else len(rows) >= 0.9 * len(want), (len(rows), len(want))


def test_edges(spark):
    long = " ".join(VOCABULARY[:300])
    docs = [(1, None), (2, ""), (3, "one two three"), (4, long + " x " + long), (5, " ".join(VOCABULARY[:290])), (6, " ".join(VOCABULARY[:200])), (None, "one, two; THREE"), (7, "three two one"), (8, "one two three " * 40_000)]
    items = [(1, "one two three"), (2, long), (None, "one two three"), (3, None), (4, "")]
    d, i = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(items, "item int, q string")
    got = {tuple(x) for x in find_near_passages(d, "doc", "text", i, "item", ["q"]).collect()}
    assert got == {(n, k) for n in (1, None) for k in (3, None, 8)} | {(2, 4), (2, 5)}
    assert find_near_passages(d.limit(0), "doc", "text", i, "item", ["q"]).collect() == find_near_passages(d, "doc", "text", i.limit(0), "item", ["q"]).collect() == []


def test_long_passages_and_many_documents(spark):
    r = np.random.default_rng(1)
    long = " ".join(f"v{x}" for x in r.integers(0, 5000, 40_000))
    cut = long.split(" ")
    changed = " ".join([*cut[:20_000], "changed", *cut[20_001:]])
    d = spark.createDataFrame([(1, changed), (2, " ".join(reversed(cut)))] + [(i, "a b c d e f g") for i in range(3, 400)], "doc int, text string").coalesce(1)
    i = spark.createDataFrame([(1, long), (2, "a b c d e f g")], "item int, q string")
    got = {tuple(x) for x in find_near_passages(d, "doc", "text", i, "item", ["q"]).collect()}
    assert got == {(1, 1)} | {(2, k) for k in range(3, 400)}
