"""Nested records into linked tables."""

import json
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from sparkloom.operators.nested import Kind, flatten_records

KINDS = [Kind("batch", "bid", ("stmt",)), Kind("change", "did", ("mult",))]


def _walk(v, bid, out):
    if isinstance(v, dict):
        if "did" in v:
            out.append((json.dumps(bid) if bid is not None else None, json.dumps(v["did"])))
        inner = v["bid"] if "bid" in v else bid
        for x in v.values():
            _walk(x, inner, out)
    elif isinstance(v, list):
        for x in v:
            _walk(x, bid, out)
    elif isinstance(v, str) and v.strip()[:1] in ("[", "{") and v.strip():
        try:
            w = json.loads(v)
        except ValueError:
            return
        _walk(w, bid, out)


def _value(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.2:
        return r.choice([1, -2.5, None, True, "", "text", 'did "7"', "a\\b", "[not json", "é{", " {x", "\n"])
    if kind < 0.4:
        return [_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    if kind < 0.55:
        return json.dumps(_value(r, depth - 1), indent=r.choice([None, 1]))
    o = {r.choice(["maps", "sub", "x", "note", "di\"d", "did\\"]): _value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if r.random() < 0.5:
        o |= {k: r.randint(0, 99) for k in r.choice([["bid"], ["did"], ["bid", "did"], ["did", "bid"]])}
    return o


def _flat(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return flatten_records(df, ["id"], "t", KINDS)


def test_against_a_walk(spark):
    r = random.Random(11)
    texts = [json.dumps(_value(r, 6), indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5) for _ in range(1500)]
    got = {}
    for x in _flat(spark, texts).where("kind = 'change'").collect():
        got.setdefault(x.id, []).append((x.batch_id, x.change_id))
    for i, t in enumerate(texts):
        want = []
        _walk(json.loads(t), None, want)
        key = lambda p: (p[0] or "", p[1])
        assert sorted(got.get(i, []), key=key) == sorted(want, key=key), t


def test_links_and_fields(spark):
    text = '{"bid":1,"stmt":[1, "}"],"sub":{"bid":2,"d":"[{\\"did\\":3,\\"mult\\": -1 ,\\"undo\\":{\\"did\\":4}}]"}}'
    rows = {(r.kind, r.batch_id, r.change_id): r for r in _flat(spark, [text]).collect()}
    b1, b2, c3, c4 = rows["batch", "1", None], rows["batch", "2", None], rows["change", "2", "3"], rows["change", "2", "4"]
    assert (b1.parent, b2.parent, c3.parent, c4.parent) == (None, b1.node, b2.node, c3.node)
    assert (b1.stmt, b2.stmt, c3.mult, c4.mult) == ('[1, "}"]', None, "-1", None)
    assert len({b1.node, b2.node, c3.node, c4.node}) == 4


def test_object_of_several_kinds(spark):
    text = '{"did":1,"bid":7,"mult":2,"stmt":3,"x":{"did":2,"y":{"bid":8}}}'
    rows = {(r.kind, r.batch_id if r.kind == "batch" else r.change_id): r for r in _flat(spark, [text]).collect()}
    assert set(rows) == {("batch", "7"), ("change", "1"), ("change", "2"), ("batch", "8")}
    b7, c1, c2, b8 = rows["batch", "7"], rows["change", "1"], rows["change", "2"], rows["batch", "8"]
    assert b7.node == c1.node and (c1.batch_id, c1.batch_node, c2.batch_id, c2.batch_node) == (None, None, "7", b7.node)
    assert (b7.stmt, b7.mult, c1.stmt, c1.mult) == ("3", None, None, "2")
    assert (b7.outer_id, c1.outer_id, c2.outer_id, b8.outer_id, b8.outer) == (None, None, "1", "7", b7.node)
    assert (b8.change_id, b7.change_id, c2.parent) == ("2", None, b7.node)
    held = json.dumps({"bid": 5, "did": 6, "s": json.dumps([{"did": 9}])})
    assert {(r.change_id, r.batch_id, r.outer_id) for r in _flat(spark, [held]).where("kind = 'change'").collect()} == {("6", None, None), ("9", "5", "6")}


def test_edges(spark):
    assert _flat(spark, [None, "", " ", "null", "[", "{]", '{"did"', '"did"', '{"a":"did"}']).collect() == []
    assert spark.createDataFrame([], "id int, t string").transform(lambda d: flatten_records(d, ["id"], "t", KINDS)).collect() == []
    escaped = r'{"did":5}'
    assert [(r.change_id, r.batch_id) for r in _flat(spark, [escaped, escaped]).collect()] == [("5", None)] * 2
    deep = '{"a":' * 3000 + '{"did":1}' + "}" * 3000
    assert [r.change_id for r in _flat(spark, [deep]).collect()] == ["1"]
    long = json.dumps([{"bid": 1, "d": [{"did": i} for i in range(50000)]}])
    assert _flat(spark, [long]).where("kind = 'change' AND batch_id = '1'").count() == 50000
    clash = spark.createDataFrame([(1, '{"did":1}')], "kind int, text string")
    assert flatten_records(clash, ["kind"], "text", KINDS).columns[:3] == ["kind", "kind_2", "node"]


@given(st.text(alphabet='{}[]",:\\did01 ', max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_is_survived(t):
    import pyarrow as pa

    from sparkloom.operators.nested import _records

    rec, *_ = _records(pa.array([t, '{"did":1}', t]), KINDS)
    assert np.count_nonzero(rec == 1) == 1
