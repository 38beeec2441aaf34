"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.leakage import find_leaks
from sparkloom.llm.near import find_near_passages
from sparkloom.llm.packing import CAPACITY, container_pieces, pack_texts
from sparkloom.llm.truncation import find_truncated, limits_of_sources, text_lengths
from sparkloom.llm.truncation_sql import P9_FOUND, P9_LIMITS, P9_SOURCES
from sparkloom.plans.registry import Registry
from sparkloom.session import cut
from sparkloom.tables import table

REGISTRY = Registry()
query = REGISTRY.add


@query("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text")


@query("p7_containers")
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = pack_texts(table(spark, d, "documents"), "doc_id", "text")
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("used"), F.max("unused").alias("unused"))


@query("p7_rebuilt", "SELECT doc_id, strlen(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS digest, true AS fits FROM documents")
def p7_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from what its containers hold, and whether its containers are full to the token they tell and its parts come whole."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    packed = cut(pack_texts(docs, "doc_id", "text"))
    used = packed.groupBy("container").agg((F.sum("n_tokens") + F.max("unused") == CAPACITY).alias("even"), (F.min("unused") == F.max("unused")).alias("one"), (F.min("unused") >= 0).alias("within"))
    whole = (F.col("first_token") == F.col("part") * CAPACITY) & (F.col("even") & F.col("one") & F.col("within"))
    sound = packed.join(used, "container").groupBy("doc_id").agg((F.every(whole) & (F.max("part") + 1 == F.count(F.lit(1)))).alias("fits"))
    pieces = container_pieces(docs, "doc_id", "text", packed)
    ordered = F.array_sort(F.collect_list(F.struct("part", F.hex("piece").alias("hex"))))
    text = pieces.groupBy("doc_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["hex"]), "")).alias("t"))
    return text.join(sound, "doc_id").select("doc_id", F.octet_length("t").cast("long").alias("bytes"), F.md5("t").alias("digest"), "fits")


# of what NFKC changes in words, full-width letters and digits occur in these texts
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x30, 0x7B) if chr(c).isalnum())
_PLAIN = "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum())
_WORDS = f"[x for x in regexp_split_to_array(lower(translate({{}}, '{_WIDE}', '{_PLAIN}')), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+') if x <> '']"
_RUNS = "SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS run FROM ({source}), UNNEST(range(1, len(w) - 8)) AS r(i)"
_LEAKS = (
    "WITH d AS ("
    + _RUNS.format(key="doc_id", source=f"SELECT doc_id, {_WORDS.format('text')} AS w FROM documents")
    + "), e AS ("
    + " UNION ".join(_RUNS.format(key="item_id", source=f"SELECT item_id, {_WORDS.format(c)} AS w FROM eval_items") for c in ("question", "answer"))
    + ")"
)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "answer"], window=10, exact=True)


@query("p8_found", _LEAKS + " SELECT DISTINCT item_id, doc_id FROM d JOIN e USING (run)")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


@query("p8_items", _LEAKS + " SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM d JOIN e USING (run) GROUP BY item_id")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


@query("p8_near")
def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with nearly the whole question or answer of an item."""
    return find_near_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "answer"])


@query("p9_found", P9_FOUND)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(table(spark, d, "documents"), "doc_id", "text", "source").where("truncated").select(F.col("key").alias("doc_id")).distinct()


@query("p9_sources", P9_SOURCES)
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    cut_off = find_truncated(table(spark, d, "documents"), "doc_id", "text", "source")
    n = F.count(F.lit(1))
    return cut_off.groupBy("source").agg(n.alias("n_docs"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("truncated") & F.col("at_limit")).alias("n_at_limit"), (F.count_if("truncated") / n).alias("share"))


@query("p9_limits", P9_LIMITS)
def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = text_lengths(table(spark, d, "documents"), "text", "source")
    return limits_of_sources(rows).withColumns({"expected": F.round("expected", 6), "p": F.round("p", 9)})
