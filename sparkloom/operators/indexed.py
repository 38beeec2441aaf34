"""Secondary indexes: an index is a filter or join on its key, which Parquet statistics, partitions or buckets prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.bag import null_safe
from sparkloom.operators.sizes import fits_broadcast
from sparkloom.operators.versioned import frontier


def _equal(key: dict) -> Column:
    on = F.lit(True)
    for c, v in key.items():
        on = on & (F.col(c) == v)
    return on


def lookup_by(df: DataFrame, order: list[str], /, **key) -> DataFrame:
    """The first match by `order`, or no row."""
    row = F.min(F.struct(*order, *[c for c in df.columns if c not in order])).alias("b")
    return df.where(_equal(key)).agg(row).where("b IS NOT NULL").select(*[F.col(f"b.`{c}`").alias(c) for c in df.columns])


def slice_by(df: DataFrame, /, **key) -> DataFrame:
    return df.where(_equal(key))


def range_by(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows with a key in the closed range."""
    return df.where(F.col(column).between(low, high))


def fold_slice_by(df: DataFrame, key: dict, /, **aggregates: Column) -> DataFrame:
    return slice_by(df, **key).agg(*[c.alias(n) for n, c in aggregates.items()])


def fold_range_by(df: DataFrame, column: str, low, high, /, **aggregates: Column) -> DataFrame:
    return range_by(df, column, low, high).agg(*[c.alias(n) for n, c in aggregates.items()])


def lookup_before_by(df: DataFrame, keys: list[str], vid: str, v, order: list[str], /, **key) -> DataFrame:
    return lookup_by(frontier(df, keys, vid, v), order, **key)


def fold_slice_vid_by(df: DataFrame, keys: list[str], vid: str, v, key: dict, /, **aggregates: Column) -> DataFrame:
    """Aggregates over the slice of the frontier, which may use the version."""
    return slice_by(frontier(df, keys, vid, v), **key).agg(*[c.alias(n) for n, c in aggregates.items()])


def fold_slices(df: DataFrame, probes: DataFrame, by: list[str], /, **aggregates: Column) -> DataFrame:
    """The fold of the slice of each probe: what a filter and a fold per probe would give, by one aggregation per key and a join.

    Probes keep all their columns; for a key without rows the aggregates are null. Null keys are values.
    """
    asked = probes.select(*by).distinct()
    asked = F.broadcast(asked) if fits_broadcast(asked) else asked
    folded = df.alias("d").join(asked.alias("a"), null_safe("d", "a", by), "left_semi").groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return probes.alias("p").join(folded.alias("f"), null_safe("p", "f", by), "left").select("p.*", *[f"f.{n}" for n in aggregates])
