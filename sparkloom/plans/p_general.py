"""Queries of the general data-preparation operators over the trace tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.operators.features import apply_deltas, feature_table, later_arrivals, signed, type_features
from sparkloom.operators.heavy import skew_aggregate, skew_join
from sparkloom.operators.nested import Kind, flatten_records
from sparkloom.operators.rejects import Layout, load_lines, rejected, sound
from sparkloom.operators.tablediff import diff_copies
from sparkloom.operators.wide import eav_to_wide, pivot_rows
from sparkloom.plans.p_sql import FIRST_ARRIVALS, JSON_TOKEN, P1, P2, P2_MESSAGES, P2_REJECTS, P4, P4_BATCHES, P4_CHANGES, P4_MAPS, p1_typed as p1_typed_sql, p6_wide
from sparkloom.plans.registry import query
from sparkloom.session import cut
from sparkloom.tables import table

MESSAGE = ["job_id", "mess_id", "dest_peer"]


def _declared(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """The declared variables; as many as the wide table has columns."""
    return [(r.key, r.type) for r in table(spark, d, "global_keys").dropna().orderBy("key").collect()]


@query("p1_found", P1)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wide = eav_to_wide(table(spark, d, "globals"), MESSAGE, "key", "value", _declared(spark, d))
    return pivot_rows(wide, MESSAGE)


@query("p1_wide")
def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return eav_to_wide(table(spark, d, "globals"), MESSAGE, "key", "value", _declared(spark, d)).drop("unfilled")


@query("p1_typed", p1_typed_sql)
def p1_typed(spark: SparkSession, d: str) -> DataFrame:
    """p1_wide with collections as their sorted tokens, for the comparison with SQL."""
    tokens = {k: F.array_join(F.array_sort(F.regexp_extract_all(k, F.lit(JSON_TOKEN), F.lit(0))), " ") for k, t in _declared(spark, d) if t == "collection"}
    return p1_wide(spark, d).withColumns(tokens)


LINE = Layout(["mess_id", "dest_peer", "trigger", "source_peer", "contents", "time"], ["contents"], ["time"])
LINE_KEEP = ["line_id", "job_id", "file_name"]


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(table(spark, d, "trace_lines"), "line", LINE, LINE_KEEP, {"mess_id": "int", "time": "int"})


@query("p2_found", P2)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(load_lines(table(spark, d, "trace_lines"), "line", LINE, ["line_id"]), ["line_id"]).drop("reason")


@query("p2_rejects", P2_REJECTS)
def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejected(_loaded(spark, d), LINE_KEEP)


@query("p2_messages", P2_MESSAGES)
def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    return sound(_loaded(spark, d))


@query(
    "p5_found",
    """SELECT dest_peer, trigger FROM messages WHERE trigger IS NOT NULL GROUP BY ALL
       HAVING count(*) > 0.01 * (SELECT count(*) FROM messages)""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs above 1 % of all rows, by exact counts of all pairs."""
    rows = table(spark, d, "messages").select("dest_peer", "trigger")
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    counts = skew_aggregate(rows.where("trigger IS NOT NULL"), ["dest_peer", "trigger"], {"n": F.count(F.lit(1))}, {"n": F.sum})
    return counts.where(F.col("n") > 0.01 * total.scalar()).select("dest_peer", "trigger")


@query(
    "p5_pairs",
    """SELECT dest_peer, trigger, count(*) AS n, min(time) AS first_time, max(time) AS last_time, sum(CAST(time AS BIGINT))::BIGINT AS total_time,
              count(source_peer) AS n_with_source FROM messages GROUP BY ALL""",
)
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").select("dest_peer", "trigger", "time", "source_peer")
    sums = {
        "n": F.count(F.lit(1)),
        "first_time": F.min("time"),
        "last_time": F.max("time"),
        "total_time": F.sum(F.col("time").cast("long")),
        "n_with_source": F.count("source_peer"),
    }
    merge = {"n": F.sum, "first_time": F.min, "last_time": F.max, "total_time": F.sum, "n_with_source": F.sum}
    return skew_aggregate(rows, ["dest_peer", "trigger"], sums, merge)


@query(
    "p5_joined",
    """SELECT p.role, t.family, count(*) AS n FROM messages m JOIN peers p ON m.dest_peer = p.address JOIN trigger_list t ON m.trigger = t.trigger GROUP BY ALL""",
)
def p5_joined(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").select("dest_peer", "trigger")
    peers = table(spark, d, "peers").select(F.col("address").alias("dest_peer"), "role")
    families = table(spark, d, "trigger_list")
    joined = skew_join(skew_join(rows, peers, ["dest_peer"]), families, ["trigger"])
    return joined.groupBy("role", "family").agg(F.count(F.lit(1)).alias("n"))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return diff_copies(
        table(spark, d, "correct"), table(spark, d, "results"), ["query", "c0"], ["c1", "c2", "c3", "c4"],
        trim=("c0", "c1"), tolerance={"c3": 0.01}, distinct=True, names=("correct_only", "results_only"),
    )


_P3_SIDES = """WITH l AS (SELECT DISTINCT query, trim(c0) AS c0, trim(c1) AS c1, c2, c3, c4 FROM correct),
 r AS (SELECT DISTINCT query, trim(c0) AS c0, trim(c1) AS c1, c2, c3, c4 FROM results),
 b AS (SELECT l.query, l.c0, l.c1 AS l1, r.c1 AS r1, l.c2 AS l2, r.c2 AS r2, l.c3 AS l3, r.c3 AS r3, l.c4 AS l4, r.c4 AS r4
       FROM l JOIN r ON l.query = r.query AND l.c0 = r.c0)
"""


@query(
    "p3_found",
    _P3_SIDES
    + """SELECT query, c0, 'correct_only' AS field FROM (SELECT query, c0 FROM l EXCEPT SELECT query, c0 FROM r)
 UNION ALL SELECT query, c0, 'results_only' FROM (SELECT query, c0 FROM r EXCEPT SELECT query, c0 FROM l)
 UNION ALL SELECT query, c0, 'c1' FROM b WHERE l1 IS DISTINCT FROM r1
 UNION ALL SELECT query, c0, 'c2' FROM b WHERE l2 IS DISTINCT FROM r2
 UNION ALL SELECT query, c0, 'c3' FROM b
   WHERE NOT ((l3 IS NULL AND r3 IS NULL) OR coalesce(isfinite(l3) AND isfinite(r3) AND abs(l3 - r3) < 0.01, false))
 UNION ALL SELECT query, c0, 'c4' FROM b WHERE l4 IS DISTINCT FROM r4""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).where(~F.col("field").endswith("_extra")).select("query", "c0", "field").distinct()


# infinite, not-a-number and large values as Spark writes them
_P3_DIGITS = "rtrim(replace(CAST(abs({c}) AS VARCHAR), '.', ''), '0')"
_P3_TEXT = f"""CASE WHEN isnan({{c}}) THEN 'NaN' WHEN isinf({{c}}) THEN CASE WHEN {{c}} > 0 THEN 'Infinity' ELSE '-Infinity' END
   WHEN abs({{c}}) >= 1e7 THEN concat(CASE WHEN {{c}} < 0 THEN '-' END, left({_P3_DIGITS}, 1), '.', CASE WHEN length({_P3_DIGITS}) = 1 THEN '0' ELSE substring({_P3_DIGITS}, 2) END, 'E', CAST(floor(log10(abs({{c}}))) AS INT))
   ELSE CAST({{c}} + 0.0 AS VARCHAR) END"""


@query(
    "p3_diff",
    _P3_SIDES
    + """SELECT query, c0, 'correct_only' AS field, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value, count(*) AS copies FROM l ANTI JOIN r ON l.query IS NOT DISTINCT FROM r.query AND l.c0 IS NOT DISTINCT FROM r.c0 GROUP BY query, c0
 UNION ALL SELECT query, c0, 'results_only', NULL, NULL, count(*) FROM r ANTI JOIN l ON l.query IS NOT DISTINCT FROM r.query AND l.c0 IS NOT DISTINCT FROM r.c0 GROUP BY query, c0
 UNION ALL SELECT query, c0, 'c1', l1, r1, 1 FROM b WHERE l1 IS DISTINCT FROM r1
 UNION ALL SELECT query, c0, 'c2', l2::VARCHAR, r2::VARCHAR, 1 FROM b WHERE l2 IS DISTINCT FROM r2
 UNION ALL SELECT query, c0, 'c3', """
    + f"{_P3_TEXT.format(c='l3')}, {_P3_TEXT.format(c='r3')}"
    + """, 1 FROM b WHERE NOT ((l3 IS NULL AND r3 IS NULL) OR coalesce(isfinite(l3) AND isfinite(r3) AND abs(l3 - r3) < 0.01, false))
 UNION ALL SELECT query, c0, 'c4', l4, r4, 1 FROM b WHERE l4 IS DISTINCT FROM r4""",
)
def p3_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


FEATURES = ("count", "last_time", "sources")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("dest_peer", "trigger", "source_peer", "time")


def _triggers(spark: SparkSession, d: str) -> list[str]:
    """The event types, as many as the feature table has groups of columns."""
    return [r.trigger for r in table(spark, d, "trigger_list").where("trigger IS NOT NULL").select("trigger").distinct().orderBy("trigger").collect()]


@query("p6_maintained", partial(p6_wide, FIRST_ARRIVALS))
def p6_maintained(spark: SparkSession, d: str) -> DataFrame:
    """The features with every message counted at its first arrival.

    All arrivals of every other run make a state; a later batch brings the other runs and takes the repeated arrivals of all runs back.
    """
    rows = table(spark, d, "messages").select("job_id", "mess_id", "dest_peer", "trigger", "source_peer", "time")
    cell = ["dest_peer"], "trigger", "source_peer", "time"
    early = F.coalesce(F.col("job_id") % 2 == 0, F.lit(False))
    first, second = (signed(rows.where(w).select("dest_peer", "trigger", "source_peer", "time"), 1) for w in (early, ~early))
    state = cut(apply_deltas(None, first, *cell))
    back = cut(later_arrivals(rows, MESSAGE, ["time", "trigger", "source_peer"]).select("dest_peer", "trigger", "source_peer", "time", (-F.col("copies")).alias("sign")))
    cells = apply_deltas(state, second.unionByName(back), *cell, log=first)
    return feature_table(cells, ["dest_peer"], "trigger", "source_peer", _triggers(spark, d))


@query("p6_features", p6_wide)
def p6_features(spark: SparkSession, d: str) -> DataFrame:
    cells = apply_deltas(None, signed(_events(spark, d), 1), ["dest_peer"], "trigger", "source_peer", "time")
    return feature_table(cells, ["dest_peer"], "trigger", "source_peer", _triggers(spark, d))


@query(
    "p6_cells",
    "SELECT dest_peer, trigger, count(*) AS n, max(time) AS last_time, count(DISTINCT source_peer) AS sources FROM messages GROUP BY ALL",
)
def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = apply_deltas(None, signed(_events(spark, d), 1), ["dest_peer"], "trigger", "source_peer", "time")
    return type_features(cells, ["dest_peer"], "trigger", "source_peer").select("dest_peer", "trigger", F.col("count").alias("n"), F.col("last_time").cast("int").alias("last_time"), "sources")


NESTED = [
    Kind("batch", "bid", ("bid", "stmt")),
    Kind("change", "did", ("did", "key", "mult", "val", "note")),
    Kind("map", "name", ("name",)),
]


def _nested_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that may hold batches, maps or changes: contents of messages, and pending_log among the variables."""
    # an object of any kind has its marker in quotes or with an escape
    may = lambda c: F.col(c).contains('id') | F.col(c).contains("name") | F.col(c).contains("\\u")
    m = table(spark, d, "messages").where(may("contents")).select(F.lit("messages").alias("src"), *MESSAGE, F.col("contents").alias("text"))
    is_log = F.regexp_replace(F.lower("key"), r"^\s+|\s+$", "") == "pending_log"
    g = table(spark, d, "globals").where(may("value") & is_log).select(F.lit("globals").alias("src"), *MESSAGE, F.col("value").alias("text"))
    return m.unionByName(g)


def _flat(spark: SparkSession, d: str, only: str | None = None) -> DataFrame:
    texts = _nested_texts(spark, d)
    if only:
        texts = texts.where(F.col("text").contains(only) | F.col("text").contains("\\u"))
    return flatten_records(texts, ["src", *MESSAGE], "text", NESTED)


@query("p4_found", P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    flat = flatten_records(
        _nested_texts(spark, d).where(F.col("text").contains("did") | F.col("text").contains("\\u")),
        ["src", *MESSAGE], "text", [Kind("change", "did"), Kind("batch", "bid")],
    )
    ids = flat.where("kind = 'change'").select("src", *MESSAGE, F.expr("try_cast(batch_id AS bigint)").alias("bid"), F.expr("try_cast(change_id AS bigint)").alias("did"))
    return ids.distinct()


@query("p4_nodes")
def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all three tables with the numbers that link them."""
    flat = _flat(spark, d)
    return flat.select("src", *MESSAGE, "kind", "node", "parent", "outer", "batch_node", "change_node", "map_node")


def _whole(c: str, to: str = "bigint") -> Column:
    return F.expr(f"try_cast({c} AS {to})")


def _text(c: str) -> Column:
    """A JSON string as text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


@query("p4_batches", P4_BATCHES)
def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    flat = _flat(spark, d, "bid").where("kind = 'batch'")
    return flat.select("src", *MESSAGE, _whole("outer_id").alias("parent_bid"), _whole("bid").alias("bid"), _whole("stmt", "int").alias("stmt")).distinct()


@query("p4_maps", P4_MAPS)
def p4_maps(spark: SparkSession, d: str) -> DataFrame:
    flat = _flat(spark, d, "name").where("kind = 'map'")
    return flat.select("src", *MESSAGE, _whole("batch_id").alias("bid"), _text("name").alias("name")).distinct()


@query("p4_changes", P4_CHANGES)
def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    flat = _flat(spark, d, "did").where("kind = 'change'")
    key, val = F.from_json("key", "array<bigint>"), F.from_json("val", "sum double, cnt bigint")
    return flat.select(
        "src", *MESSAGE, _whole("batch_id").alias("bid"), _text("map_id").alias("map"), _whole("outer_id").alias("parent_did"), _whole("did").alias("did"),
        F.array_join(key, ",").alias("key"), _whole("mult", "int").alias("mult"), val["sum"].alias("val_sum"), val["cnt"].alias("val_cnt"),
    ).distinct()
