"""Cut texts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.truncation import GUARD, REACH, find_truncated, length_limits, with_ending

ENDINGS = [
    ("It ends here.", "sentence"), ("Does it?", "sentence"), ('"It ends here."', "sentence"), ("(It ends here.)\n\n", "sentence"), ("It is 35.54.", "sentence"), ("for kake57.", "sentence"),
    ("It ends he", "open"), ("the watermark 18.", "open"), ("a word,", "open"), ("(It ends here.", "open"), ("# Title", "open"), ("an identifier_", "open"),
    ("broken �", "cut"), ("esc \\u00", "cut"), ("ent &quo", "cut"), ("The rest …", "cut"), ("The rest [...]", "cut"), ("a &quot;b.&quot;", "sentence"),
    ("```\ncode\n```", "fence"), ("```\ncode.", "code"), ("Done.\n\n-- Maro, view team", "signature"), ("Done.\nrows=1 peers=2 status=ok", "status"), ('Done.\n{"run": 1}', "record"),
    ("Done.\nSee also: tope", "reference"), ("Fin.\nVoir aussi : tope", "reference"), ("Still looking into it...", "dots"), ("   \n", "blank"), ("", "blank"), (None, None),
]


@pytest.mark.parametrize("text, form", ENDINGS)
def test_forms(spark, text, form):
    df = spark.createDataFrame([(text,)], "t string")
    assert with_ending(df, "t").first().form == form


def test_limits_stand_out(spark):
    r = random.Random(1)
    lengths = [("a", r.randint(50, 1500)) for _ in range(2000)] + [("a", 1000)] * 40 + [("b", r.randint(50, 3000)) for _ in range(2000)] + [(None, 77)] * 3
    found = {(x.s, x.length) for x in length_limits(spark.createDataFrame(lengths, "s string, l int"), ["s"], "l").collect()}
    assert ("a", 1000) in found
    assert len([f for f in found if f[0] in ("a", "b")]) == 1
    assert length_limits(spark.createDataFrame([], "s string, l int"), ["s"], "l").collect() == []


def test_expected_number_follows_the_neighbouring_hazard(spark):
    """At least at_risk * endings / texts at risk of all lengths in reach; inside the distribution it isn't the sum of both sides, so a weak limit is seen."""
    r = random.Random(2)
    lengths = [r.randint(1, 1500) for _ in range(3000)] + [700] * 12
    got = {x.length: x for x in length_limits(spark.createDataFrame([(x,) for x in lengths], "l int").withColumn("s", F.lit("a")), ["s"], "l", 0.9999).collect()}
    for l, x in got.items():
        near = {m for m in range(max(0, l - REACH), l + REACH + 1) if abs(m - l) > GUARD}
        risk = lambda m: sum(y >= m for y in lengths)
        assert x.at_risk == risk(l)
        ends = lambda at: sum(y in at for y in lengths) + 0.5
        hazard = risk(l) * ends(near) / sum(map(risk, near))
        assert x.expected == pytest.approx(max(hazard, *(ends({m for m in near if (m < l) == low}) / (REACH - GUARD) for low in (True, False))))
    strong = {x.length for x in length_limits(spark.createDataFrame([(x,) for x in lengths], "l int").withColumn("s", F.lit("a")), ["s"], "l").collect()}
    assert strong == {700}


def _sentences(r, n):
    out = ""
    while len(out) < n:
        out += " ".join(r.choice("rows keys map view node peer waits drops".split()) for _ in range(r.randint(4, 9))).capitalize() + ". "
    return out


def test_dots_by_limit_and_wording(spark):
    r = random.Random(5)
    rows = [(i, _sentences(r, r.randint(100, 1500)).strip(), "s") for i in range(400)]
    rows += [(1000 + i, _sentences(r, 900)[:897] + "...", "s") for i in range(20)]  # a limit of 900 with a mark of omission
    rows += [(2000 + i, _sentences(r, r.randint(100, 800)).strip() + f"\nStill looking into x{i}...", "s") for i in range(60)]
    rows += [(3000, "  " + rows[400][1] + "\n", "other"), (3001, None, "s"), (3002, "", None), (3003, "Cut in the mid", None), (3003, "Cut in the mid", None)]
    df = spark.createDataFrame(rows, "doc int, body string, src string").withColumn("key", F.lit(1)).withColumn("truncated", F.lit(1))
    got = {x.key for x in find_truncated(df, "doc", "body", "src").where("truncated").collect()}
    assert got == {*range(1000, 1020), 3000, 3003}
    assert find_truncated(df, "doc", "body", "src").count() == len(rows)


def test_empty(spark):
    assert find_truncated(spark.createDataFrame([], "doc int, body string, src string"), "doc", "body", "src").collect() == []
