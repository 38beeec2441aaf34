"""Range and nearest-key operators of sorted sets and maps. Null keys stand outside any order and never match."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T


def _first(df: DataFrame, key: str, low: bool) -> DataFrame:
    """The row with the least or greatest key as a one-row plan of partial aggregates, not a sort; ties go by the other columns."""
    row = F.struct(F.col(key), *[F.col(c) for c in df.columns if c != key])
    best = (F.min if low else F.max)(row).alias("b")
    return df.where(F.col(key).isNotNull()).agg(best).where("b IS NOT NULL").select(*[F.col(f"b.`{c}`").alias(c) for c in df.columns])


def least(df: DataFrame, key: str) -> DataFrame:
    return _first(df, key, True)


def greatest(df: DataFrame, key: str) -> DataFrame:
    return _first(df, key, False)


def filter_lt(df: DataFrame, key: str, bound) -> DataFrame:
    return df.where(F.col(key) < bound)


def filter_gt(df: DataFrame, key: str, bound) -> DataFrame:
    return df.where(F.col(key) > bound)


def filter_leq(df: DataFrame, key: str, bound) -> DataFrame:
    return df.where(F.col(key) <= bound)


def filter_geq(df: DataFrame, key: str, bound) -> DataFrame:
    return df.where(F.col(key) >= bound)


def between(df: DataFrame, key: str, low, high) -> DataFrame:
    return df.where(F.col(key).between(low, high))


def lower_bound(df: DataFrame, key: str, bound) -> DataFrame:
    """First row with a key of at least the bound."""
    return least(filter_geq(df, key, bound), key)


def upper_bound(df: DataFrame, key: str, bound) -> DataFrame:
    """First row with a key above the bound."""
    return least(filter_gt(df, key, bound), key)


def lookup_lt(df: DataFrame, key: str, k) -> DataFrame:
    return greatest(filter_lt(df, key, k), key)


def lookup_leq(df: DataFrame, key: str, k) -> DataFrame:
    return greatest(filter_leq(df, key, k), key)


lookup_gt, lookup_geq = upper_bound, lower_bound


def erase_before(df: DataFrame, key: str, bound) -> DataFrame:
    """Without keys below the bound, also if the bound is beyond all of them."""
    return filter_geq(df, key, bound)


def erase_after(df: DataFrame, key: str, bound) -> DataFrame:
    return filter_leq(df, key, bound)


def peek(df: DataFrame, key: str) -> Row | None:
    rows = least(df, key).collect()
    return rows[0] if rows else None


def nearest(probes: DataFrame, probe: str, table: DataFrame, key: str, value: str, mode: str) -> DataFrame:
    """lookup_lt, _leq, _gt or _geq of many probes at once: probes with `<key>` and `<value>` of the nearest key, null if none.

    One union sorted by range partitions; within them the last (or next) key is carried along by a window over range buckets: first the best key per
    bucket, then over buckets, so that no task holds all rows.
    """
    if mode not in ("lt", "leq", "gt", "geq"):
        raise ValueError("mode is lt, leq, gt or geq")
    from sparkloom.session import cut

    back = mode in ("lt", "leq")
    # among equal keys, rows of the table come before the probe if they may match it
    first = (mode == "leq") if back else (mode == "gt")
    table_rank = 0 if first else 1
    t = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_at")).agg(F.min(value).alias("_value")).select("_at", F.lit(table_rank).alias("_rank"), F.struct(F.col("_at").alias("k"), F.col("_value").alias("v")).alias("_hit"), F.lit(None).cast(probes.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_p"))
    p = probes.select(F.col(probe).alias("_at"), F.lit(1 - table_rank).alias("_rank"), F.lit(None).cast(t.schema["_hit"].dataType).alias("_hit"), F.struct(*probes.columns).alias("_p"))
    rows = cut(t.unionByName(p.where("_at IS NOT NULL")).repartitionByRange("_at").withColumn("_part", F.spark_partition_id()))
    ends = rows.where("_hit IS NOT NULL").groupBy("_part").agg((F.max if back else F.min)("_hit").alias("_end"))
    over = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING" if back else "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    pick = "last" if back else "first"
    parts = rows.select("_part").distinct().join(ends, "_part", "left")  # a row per partition
    carried = parts.select("_part", F.expr(f"{pick}(_end, true) OVER (ORDER BY _part {over})").alias("_carry"))
    # looking ahead is looking back in reverse order, which a window does in one pass
    order = "_at, _rank" if back else "_at DESC, _rank DESC"
    local = rows.withColumn("_near", F.expr(f"last(_hit, true) OVER (PARTITION BY _part ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    out = local.where("_p IS NOT NULL").join(F.broadcast(carried), "_part").withColumn("_near", F.coalesce("_near", "_carry"))
    found = out.select("_p.*", F.col("_near.k").alias(key), F.col("_near.v").alias(value))
    lost = probes.where(F.col(probe).isNull()).select("*", F.lit(None).cast(table.schema[key].dataType).alias(key), F.lit(None).cast(table.schema[value].dataType).alias(value))
    return found.unionByName(lost)


def pairs_between(left: DataFrame, point: str, right: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Range join: rows of left with those of right whose closed interval holds the point.

    Points and intervals meet in buckets of `width`, an equi-join, instead of every pair; intervals stand in each bucket they touch.
    Choose a width near that of the intervals.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    r = right.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return left.withColumn("_b", bucket(point)).join(r, "_b").where(F.col(point).between(F.col(low), F.col(high))).drop("_b")


def is_sorted(df: DataFrame, order: Column) -> bool:
    """Whether rows come in that order, as after `sort`, nulls aside. Each partition is checked where it is; a row for each says where it begins and ends."""
    kind = df.select(order.alias("k")).schema["k"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("ok", T.BooleanType())])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        ok = True
        for k in (b["k"].dropna() for b in batches):
            if len(k):
                ok &= bool(k.is_monotonic_increasing) and (last is None or last <= k.iloc[0])
                first, last = k.iloc[0] if first is None else first, k.iloc[-1]
        if first is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "ok": [ok]})

    bounds = sorted(df.select(order.alias("k")).mapInPandas(check, schema).collect())
    return all(b.ok for b in bounds) and all(a.last <= b.first for a, b in zip(bounds, bounds[1:]))
