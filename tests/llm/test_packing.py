"""Texts into containers."""

import random
from collections import Counter, defaultdict

import pytest

from sparkloom.llm.packing import container_pieces, pack_texts, plan_packing
from sparkloom.llm.tokens import token_count


def _fill(plan, counts):
    """Length of every item in its container."""
    held = defaultdict(list)
    placed = Counter()
    for length, first, n, base in plan.intervals:
        assert first == placed[length]
        placed[length] += n
        for i in range(n):
            held[base + i].append(length)
    assert placed == Counter({k: v for k, v in counts.items() if v})
    assert set(held) == set(range(plan.containers))
    starts = sorted(plan.room)
    for c, items in held.items():
        start = max(s for s in starts if s <= c)
        assert plan.capacity - sum(items) == plan.room[start] >= 0
    return held


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_item_once(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 16, 64, 200])
    counts = {n: r.choice([0, 1, 2, 3, 40]) for n in range(1, capacity + 1) if r.random() < 0.6}
    plan = plan_packing(counts, capacity)
    held = _fill(plan, counts)
    total = sum(n * c for n, c in counts.items())
    # no two containers could be one
    rooms = sorted((capacity - sum(h) for h in held.values()), reverse=True)
    if len(rooms) > 1:
        assert rooms[1] < capacity - capacity // 2 or total == 0
    assert len(plan.intervals) <= 14 * capacity + 50


def test_exact_fills_are_found():
    for combo in ((10,), (7, 3), (5, 3, 2), (4, 3, 2, 1)):
        plan = plan_packing(dict(Counter({n: 50 * k for n, k in Counter(combo).items()})), 10)
        assert plan.containers == 50 and set(plan.room.values()) == {0}
    assert plan_packing({5: 9}, 10).containers == 5
    assert plan_packing({}, 10).containers == 0
    with pytest.raises(ValueError):
        plan_packing({11: 1}, 10)


def test_frames(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += ["long text " * 500, None, "", texts[0], texts[0], "same length"] + ["same length"] * 200
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc int, body string, container int").repartition(3)
    out = pack_texts(df, "doc", "body", capacity=64)
    assert out.columns == ["container", "doc", "part", "first_token", "n_tokens", "unused"]
    got = out.collect()
    used, unused = defaultdict(int), {}
    tokens = Counter()
    for x in got:
        used[x.container] += x.n_tokens
        assert unused.setdefault(x.container, x.unused) == x.unused
        assert x.first_token == 64 * x.part
        tokens[x.doc] += x.n_tokens
    assert all(64 - used[c] == unused[c] >= 0 for c in used)
    want = Counter()
    for d, t, _ in rows:
        want[d] += token_count(t)
    assert tokens == want
    sizes = sorted(token_count(t) for _, t, _ in rows)
    assert sorted(x.n_tokens for x in got if x.n_tokens) == sorted(p for n in sizes for p in [64] * (n // 64) + [n % 64] if p)
    assert sum(1 for x in got if x.n_tokens == 0) == sum(1 for n in sizes if n == 0)
    assert len(used) <= -(-sum(sizes) // 64) + 2


def test_pieces_make_the_text(spark):
    texts = {1: "Zwölf Boxkämpfer \U0001f600\U0001f680 jagen <|endoftext|> Viktor " * 30, 2: None, 3: "", 4: "a b c", 5: " \n\n  x"}
    df = spark.createDataFrame(list(texts.items()), "doc int, body string")
    packed = pack_texts(df, "doc", "body", capacity=7)
    got = defaultdict(dict)
    for x in container_pieces(df, "doc", "body", packed).collect():
        got[x.doc][x.part] = bytes(x.piece)
    for d, t in texts.items():
        parts = got[d]
        assert sorted(parts) == list(range(max(1, -(-token_count(t) // 7))))
        assert b"".join(parts[p] for p in sorted(parts)).decode() == (t or "")


def test_edges(spark):
    none = spark.createDataFrame([], "doc int, body string")
    assert pack_texts(none, "doc", "body").collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc int, body string")
    assert {(x.container, x.doc, x.n_tokens, x.unused) for x in pack_texts(blank, "doc", "body", 8).collect()} == {(0, 1, 0, 8), (0, 2, 0, 8)}
