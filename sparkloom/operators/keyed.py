"""Maps: rows with a unique key. Mutations return a new map; a `seq` column says which of several writes is the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.bag import null_safe


def last_write(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """One row per key: that with the greatest seq, as partial aggregates before one shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(seq.alias("_s"), *rest)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest]).select(*df.columns)


def insert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows overwrite entries of their keys. Keys are unique on either side."""
    return combine(df, rows, keys)


def combine(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which entries of b win."""
    tagged = a.withColumn("_from", F.lit(0)).unionByName(b.withColumn("_from", F.lit(1)))
    return last_write(tagged, keys, F.col("_from")).drop("_from")


def lookup(df: DataFrame, probes: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Probes with the entry of their key, or defaults where there is none."""
    joined = probes.join(df.withColumn("_there", F.lit(True)), keys, "left")
    for c, v in (defaults or {}).items():
        joined = joined.withColumn(c, F.when(F.col("_there").isNull(), F.lit(v)).otherwise(F.col(c)))
    return joined.drop("_there")


def member(df: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    return lookup(df.select(*keys).distinct().withColumn("member", F.lit(True)), probes, keys, {"member": False})


def update_key(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New values for keys that exist; rows of other keys do nothing."""
    rest = [c for c in df.columns if c not in keys]
    new = rows.select(*keys, F.struct(*rest).alias("_new"))
    joined = df.join(new, keys, "left")
    return joined.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`")).otherwise(F.col(c)).alias(c) for c in rest]).select(*df.columns)


def erase_key(df: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(probes.select(*keys), keys, "left_anti")


def erase_with(df: DataFrame, probes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the map without the keys, the entries erased)."""
    return erase_key(df, probes, keys), df.join(probes.select(*keys).distinct(), keys, "left_semi")


def insert_with(df: DataFrame, rows: DataFrame, keys: list[str], /, **merge: Callable[[str], Column]) -> DataFrame:
    """Entries and rows of one key become one by merging each column, for example total=F.sum. Rows may repeat keys."""
    return df.unionByName(rows).groupBy(*keys).agg(*[f(c).alias(c) for c, f in merge.items()])


def upsert_with(df: DataFrame, probes: DataFrame, keys: list[str], absent: dict[str, Column], present: dict[str, Column]) -> DataFrame:
    """For each probed key: an entry of `absent` expressions if there is none, else its columns replaced by `present`."""
    rest = [c for c in df.columns if c not in keys]
    entries, wanted = df.withColumn("_there", F.lit(True)), probes.select(*keys).distinct().withColumn("_probed", F.lit(True))
    both = entries.alias("a").join(wanted.alias("b"), null_safe("a", "b", keys), "full_outer")
    there, probed = F.col("_there").isNotNull(), F.col("_probed").isNotNull()
    chosen = [F.when(~there, absent[c]).when(probed, present.get(c, F.col(f"a.{c}"))).otherwise(F.col(f"a.{c}")).alias(c) for c in rest]
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *chosen).select(*df.columns)


def update_with(df: DataFrame, probes: DataFrame, keys: list[str], present: dict[str, Column]) -> DataFrame:
    """The entries of the probed keys as they stand after the update."""
    hit = df.alias("a").join(probes.select(*keys).distinct(), keys, "left_semi")
    return hit.withColumns(present)


def project(df: DataFrame, key: dict[str, Column], value: dict[str, Column], seq: Column) -> DataFrame:
    """map: rows that get one key collapse to the last by seq."""
    made = df.select(*[c.alias(n) for n, c in (key | value).items()], seq.alias("_seq"))
    return last_write(made, list(key), F.col("_seq")).drop("_seq")


def equijoin_fold(outer: DataFrame, entries: DataFrame, keys: list[str], /, **aggregates: Column) -> DataFrame:
    """For each outer row its entry is looked up and the matches folded; the join and the sums are one plan."""
    return outer.join(entries, keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two halves by a hash of the key, about even and the same each time."""
    half = F.pmod(F.xxhash64(*keys), F.lit(2))
    return df.where(half == 0), df.where(half == 1)
