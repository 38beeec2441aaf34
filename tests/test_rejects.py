"""Lines that cannot be loaded."""

import random

import pyarrow as pa
import pytest

from sparkloom.operators.rejects import Layout, diagnose, load_lines, parse_block, rejected, sound

LAYOUT = Layout(["a", "j", "t"], ["j"], ["t"])


@pytest.mark.parametrize(
    "line, reason",
    [
        ("x|1|2", None), ("x|{}|2\r", None), ("x|'{}'| 2 ", None), ("'it''s'|1|2", None), ("'a|b\nc'|1|2", None), ("it's|1|2", None), ("|1|0002147483647", None),
        (None, "null_line"), ("", "field_count"), ("x|1", "field_count"), ("x|1|2|3", "field_count"), ("'x|1|2", "unclosed_quote"), ("'x'y|1|2", "text_after_quote"), ("'x'\r|1|2", "text_after_quote"),
        ("x||2", "j_empty"), ("x|''|2", "j_empty"), ("x|[1,]|2", "j_not_json"), ("x|1 2|2", "j_not_json"), ("x|NaN|2", "j_not_json"), ("x|01|2", "j_not_json"),
        ("x|1|", "t_empty"), ("x|1|  ", "t_empty"), ("x|1|-2", "t_not_digits"), ("x|1|2.0", "t_not_digits"), ("x|1|٣", "t_not_digits"), ("x|1|2147483648", "t_range"), ("x|1|'12'\r\r", "text_after_quote"),
        ("x|" + "9" * 5000 + "|2", None), ("x|" + "[" * 100000 + "|2", "j_not_json"),
    ],
)
def test_reasons(line, reason):
    assert diagnose(line, LAYOUT)[0] == reason
    assert parse_block(pa.array([line], pa.string()), LAYOUT, [8])[1] == [reason]
    mixed = ["x|1|2"] * 5 + [line] + ["y|[1]|3"] * 5
    assert parse_block(pa.array(mixed, pa.string()), LAYOUT, [1024])[1] == [None] * 5 + [reason] + [None] * 5


def test_bad_json_cannot_make_up_for_bad_json():
    lines = ["a|[1|1", "b|2]|1", "c|1,2|1", "d|1|1"]
    assert parse_block(pa.array(lines), LAYOUT, [1024])[1] == ["j_not_json", "j_not_json", "j_not_json", None]


def test_columnar_equals_strict():
    r = random.Random(3)
    parts = ["|", "'", "''", "x", "1", "{}", "[1,2]", " ", "\r", "\n", '"', "null", "é"]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    lines += [f"{r.choice(['a', chr(39) + 'a' + chr(39), ''])}|{r.choice(['1', '[]', 'x'])}|{r.choice(['1', ' 7', 'z'])}" for _ in range(3000)]
    r.shuffle(lines)
    fields, reasons = parse_block(pa.array(lines), LAYOUT, [1024])
    columns = [f.to_pylist() for f in fields]
    for i, line in enumerate(lines):
        reason, values = diagnose(line, LAYOUT)
        assert reasons[i] == reason, line
        bare = lambda row: [v.strip() if k == 2 and v else v for k, v in enumerate(row)]  # noqa: E731 - blanks around numbers don't count
        assert bare([c[i] for c in columns]) == bare(values), line


def test_frames(spark):
    rows = [(1, "a|1|5", "k"), (1, "a|1|5", "k"), (2, "bad", "k"), (None, None, None), (3, "null|'null'|7\r", "k")]
    df = spark.createDataFrame(rows, "t int, line string, reason string")
    out = load_lines(df, "line", LAYOUT, ["t", "reason"], {"t": "int"})
    assert out.columns == ["t", "reason", "a", "j", "t_2", "reason_2"]
    plain = load_lines(df.select("t", "line").withColumnRenamed("t", "id"), "line", LAYOUT, ["id"], {"t": "int"})
    assert sorted((r.id, r.a, r.j, r.t) for r in sound(plain).collect()) == [(1, "a", "1", 5), (1, "a", "1", 5), (3, None, "null", 7)]
    assert {(r.id, r.reason) for r in rejected(plain, ["id"]).collect()} == {(2, "field_count"), (None, "null_line")}
    assert load_lines(df.limit(0), "line", LAYOUT, ["t"]).collect() == []


def test_deep_json_is_sound():
    deep = "[" * 30_000 + "]" * 30_000
    lines = ["x|1|2", f"x|{deep}|2", f"x|{deep}]|2", "y|[1]|3"]
    assert parse_block(pa.array(lines, pa.string()), LAYOUT, [1024])[1] == [None, None, "j_not_json", None]
