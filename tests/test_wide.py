"""Attribute-value rows into wide tables."""

import json
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.operators.jsonvalues import _decode, _decode_deep, _plain_text, conform, is_json
from sparkloom.operators.wide import eav_to_wide, pivot_rows
from sparkloom.plans import p_general

DECLARED = [("n", "int"), ("x", "real"), ("ok", "bool"), ("s", "string"), ("addr", "address"), ("c", "collection")]


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("5", "int", ("5", False)), (" 5.00 ", "int", ("5", False)), ('"-7"', "int", ("-7", False)), ('{"type":"ind","value":"8"}', "int", ("8", False)),
        ("2147483647", "int", ("2147483647", False)), ("2147483648", "int", (None, True)), ("5.5", "int", (None, True)), ("1e2", "int", (None, True)), ('" 5"', "int", (None, True)), ("007", "int", (None, True)), ("true", "int", (None, True)),
        ("null", "int", (None, False)), (None, "int", (None, False)), ('{"value":null,"type":"int"}', "int", (None, False)), ('"null"', "int", (None, True)), ("", "int", (None, True)),
        ("5", "real", ("5.0", False)), ('"5e-1"', "real", ("0.5", False)), ("-0.0", "real", ("0.0", False)), ("NaN", "real", (None, True)), ('"3,5"', "real", (None, True)),
        ("false", "bool", ("false", False)), ('"TRUE"', "bool", ("true", False)), ("1", "bool", (None, True)), ('"yes"', "bool", (None, True)),
        ('"5"', "string", ("5", False)), ('""', "string", ("", False)), ("5", "string", (None, True)), ("abc", "string", (None, True)),
        ('"1.2.3.255:65535"', "address", ("1.2.3.255:65535", False)), ('"1.2.3.256:1"', "address", (None, True)), ('"1.2.3.4:65536"', "address", (None, True)), ('"1.2.3.4"', "address", (None, True)),
        ("[1, 2]", "collection", ("[1,2]", False)), ('{"b":1,"a":2.0}', "collection", ('{"a":2,"b":1}', False)), ('"[]"', "collection", (None, True)), ("[1,]", "collection", (None, True)),
        ('{"type":"Seq","value":[1]}', "collection", ("[1]", False)), ('{"type":"a","value":{"type":"b","value":3}}', "int", ("3", False)), ('{"type":"a","value":1,"z":1}', "int", (None, True)),
        ("[" * 100000, "collection", (None, True)), ("9" * 5000, "int", (None, True)),
    ],
)
def test_conform(text, kind, want):
    assert conform(text, kind) == want


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
@settings(max_examples=100, deadline=None)
def test_is_json_round_trip(v):
    assert is_json(json.dumps(v))
    assert not is_json(json.dumps(v) + " x")


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3)), st.integers(0, 40), st.sampled_from(["", ",", "]", "}", "1", " ", '"', ":", "x"]))
@settings(max_examples=200, deadline=None)
def test_reading_without_recursion(v, at, put):
    """Sound and broken texts read the same with a stack, and give the same canonical form."""
    text = json.dumps(v)
    text = text[:at] + put + text[at:]
    try:
        want = _decode(text)
    except ValueError:
        with pytest.raises(ValueError):
            _decode_deep(text)
        return
    assert _decode_deep(text) == want
    deep = _decode_deep('{"b":"","a":[' * 5000 + text + "]}" * 5000)
    assert _plain_text(deep) == '{"a":[' * 5000 + _plain_text(want) + '],"b":""}' * 5000


@given(
    st.one_of(
        st.from_regex(r"-?[0-9]{1,12}(\.[0-9]{1,3})?([eE]-?[0-9]{1,3})?", fullmatch=True), st.text(max_size=8).map(json.dumps), st.text(max_size=8).map(lambda t: f'"{t}"'),
        st.sampled_from(["true", "false", "True", '"1.2.3.4:5"', "-0", "0.0", "1e400"]),
    ),
    st.sampled_from(["int", "real", "bool", "string", "address", "collection"]),
)
@settings(max_examples=500, deadline=None)
def test_plain_literals_need_no_parser(text, kind):
    """Blanks around a value change nothing, and with them the parser is taken."""
    assert conform(text, kind) == conform(f" {text}\n", kind)


def test_no_cap_on_depth():
    for n in (500, 1100, 12_000, 100_000):
        deep = "[" * n + "1.0" + "]" * n
        assert is_json(deep) and not is_json(deep + "]") and not is_json(deep[:-1]) and not is_json("[" * n + "1,]" + "]" * n)
        assert conform(deep, "collection") == ("[" * n + "1" + "]" * n, False)
        assert conform('{"type":"t","value":' * n + "7" + "}" * n, "int") == ("7", False)


def _brute(rows, declared):
    cells, entities = defaultdict(lambda: [set(), False]), set()
    kinds = {k.lower(): t for k, t in declared}
    for e, k, v in rows:
        entities.add(e)
        k = (k or "").strip().lower()
        if k in kinds:
            c, bad = conform(v, kinds[k])
            cell = cells[e, k]
            if c is not None:
                cell[0].add(c)
            cell[1] |= bad
    return entities, cells


def test_against_brute_force(spark):
    r = random.Random(1)
    texts = ["1", "2", "2.0", '"1"', "1.5", "true", '"True"', "false", '"x"', '"1.2.3.4:5"', "[1]", "[1.0]", "{}", "null", None, "bad", '{"type":"t","value":2}']
    keys = ["n", " N", "x", "ok", "OK\t", "s", "addr", "c", "other", None]
    rows = [(r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.choice(keys), r.choice(texts)) for _ in range(600)]
    rows += [(9, "hot", "n", "1")] * 2000 + [(9, "hot", "zzz", "1")] * 10
    df = spark.createDataFrame(rows, "e1 int, e2 string, k string, v string").repartition(5)
    wide = {(w.e1, w.e2): w for w in eav_to_wide(df, ["e1", "e2"], "k", "v", DECLARED).collect()}
    entities, cells = _brute([((a, b), k, v) for a, b, k, v in rows], DECLARED)
    assert set(wide) == entities
    for e, w in wide.items():
        for k, kind in DECLARED:
            values, bad = cells.get((e, k), (set(), False))
            broken = bad or len(values) > 1
            assert (k in w.unfilled) == broken, (e, k)
            got = w[k]
            want = None if broken or not values else next(iter(values))
            if want is not None:
                want = {"int": int, "real": float, "bool": lambda t: t == "true"}.get(kind, str)(want)
            assert got == want, (e, k, got, want)


def test_edges(spark):
    empty = spark.createDataFrame([], "e int, k string, v string, unfilled string")
    assert eav_to_wide(empty, ["e"], "k", "v", DECLARED).collect() == []
    df = spark.createDataFrame([(1, "E", "5", "x"), (1, "e", "6", "y"), (2, None, None, None)], "e int, k string, v string, unfilled string")
    wide = eav_to_wide(df, ["e"], "k", "v", [("e", "int")])
    assert wide.columns == ["e", "e_2", "unfilled"]  # an attribute named like the entity column
    assert {(r.e, r.e_2, tuple(r.unfilled)) for r in wide.collect()} == {(1, None, ("e",)), (2, None, ())}
    assert [tuple(r) for r in pivot_rows(wide, ["e"]).collect()] == [(1, "e")]
    long = json.dumps("y" * 2_000_000)
    got = eav_to_wide(spark.createDataFrame([(1, "s", long)], "e int, k string, v string"), ["e"], "k", "v", DECLARED).first()
    assert len(got.s) == 2_000_000


def test_found_rows_come_from_the_whole_wide_table(spark, tmp_path):
    """The columns of all declared variables are made, although the query only gives the list of unfilled cells."""
    spark.createDataFrame([(1, 1, "p", "n", "5"), (1, 1, "p", "x", "bad")], "job_id int, mess_id int, dest_peer string, key string, value string").write.parquet(f"{tmp_path}/globals.parquet")
    spark.createDataFrame([("n", "int"), ("x", "real")], "key string, type string").write.parquet(f"{tmp_path}/global_keys.parquet")
    found = p_general.p1_found(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 1, "p", "x")]
    made = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "unfilled" in line and "MapInArrow" in line)
    assert "n#" in made.split("dest_peer#")[1].split("unfilled#")[0] and "x#" in made.split("dest_peer#")[1].split("unfilled#")[0]
