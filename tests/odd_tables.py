"""Odd copies of the smallest tables for the queries of data preparation."""

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
NAMES = "messages globals correct results trace_lines peers trigger_list global_keys documents eval_items".split()
CLASHING = ["_key", "_value", "_text", "_heavy", "kind", "node", "unfilled", "reason", "container", "part", "truncated", "n", "_item", "id"]


def write(spark, at: str, change) -> str:
    for name in NAMES:
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        change(df, name).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    return at


def empty(df, name):
    return df.limit(0)


def extra_columns(df, name):
    """More columns, with names that the operators use inside."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c.lower() not in have])


def nulls_and_repeats(df, name):
    """Every row twice, once more with all fields null, and once more for each field with that field null."""
    if name in ("peers", "trigger_list", "global_keys", "eval_items"):
        return df.unionByName(df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
    some = df.limit(40)
    out = df.unionByName(df).unionByName(some.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
    for c in df.columns:
        out = out.unionByName(some.withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
    return out
