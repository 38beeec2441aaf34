"""Set algebra. Rows are elements; null fields equal each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.bag import literal, null_safe


def as_set(df: DataFrame) -> DataFrame:
    return df.distinct()


def insert(df: DataFrame, *rows: tuple) -> DataFrame:
    """Adds what is absent."""
    return union(df, df.sparkSession.createDataFrame(list(rows), df.schema))


def erase(df: DataFrame, row: tuple) -> DataFrame:
    return df.distinct().subtract(literal(df, row))


def update(df: DataFrame, old: tuple, new: tuple) -> DataFrame:
    """`old` becomes `new`; nothing if `old` is absent."""
    gone = literal(df, old)
    there = df.alias("a").join(gone.alias("b"), null_safe("a", "b", df.columns), "left_semi").distinct()
    return union(df.subtract(gone), there.select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(new, df.schema)]))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def member(df: DataFrame, elements: DataFrame) -> DataFrame:
    """`elements` with `member`: whether each is in the set."""
    known = df.select(*elements.columns).distinct().withColumn("_in", F.lit(True))
    joined = elements.alias("a").join(known.alias("b"), null_safe("a", "b", elements.columns), "left")
    return joined.select("a.*", F.coalesce("b._in", F.lit(False)).alias("member"))


def is_subset_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every element of a is in b."""
    missing = a.alias("a").join(b.select(*a.columns).alias("b"), null_safe("a", "b", a.columns), "left_anti")
    return missing.agg((F.count(F.lit(1)) == 0).alias("is_subset"))


def project(df: DataFrame, /, **columns: Column) -> DataFrame:
    """map: equal results become one element."""
    return df.select(*[c.alias(n) for n, c in columns.items()]).distinct()
