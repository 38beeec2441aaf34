"""Bags and sequences: access, mutation and the bulk transformers, as plans over DataFrames.

A DataFrame has no order, so operators that need one take the ordering columns and reject their absence. Mutations return a new bag.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T


def _order(order: list) -> list:
    if not order:
        raise ValueError("this operator needs ordering columns")
    return order


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def literal(df: DataFrame, row: tuple) -> DataFrame:
    """One row with the schema of `df`."""
    return df.sparkSession.createDataFrame([row], df.schema)


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("size"))


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def peek(df: DataFrame, order: list) -> Row | None:
    """The first row by `order`, or None."""
    rows = df.orderBy(*_order(order)).take(1)
    return rows[0] if rows else None


def with_position(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Rows with their place from 0 in the total order of `order`.

    Range partitioning sorts the rows; places come from the sizes of the partitions, so no task sees all rows. The number of
    partitions, not of rows, reaches the driver. Equal rows get different places.
    """
    from sparkloom.session import cut

    ranged = cut(df.repartitionByRange(*_order(order)).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    sizes = sorted((r._part, r.n) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    local = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + local).drop("_part", "_seq", "_start")


def at(df: DataFrame, order: list, i: int) -> DataFrame:
    """The row at place i, from 0; no row if there is none."""
    return with_position(df, order, "_pos").where(F.col("_pos") == i).drop("_pos")


def safe_at(df: DataFrame, order: list, i: int, default: tuple) -> DataFrame:
    """The row at place i, or the default row."""
    found = at(df, order, i).withColumn("_k", F.lit(0))
    return found.unionByName(literal(df, default).withColumn("_k", F.lit(1))).orderBy("_k").limit(1).drop("_k")


def pop(df: DataFrame, order: list) -> DataFrame:
    """All rows but the first."""
    return with_position(df, order, "_pos").where("_pos > 0").drop("_pos")


def insert(df: DataFrame, *rows: tuple) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


def extend(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other)


combine = extend


def erase(df: DataFrame, row: tuple) -> DataFrame:
    """One row equal to `row` less; nothing if there is none."""
    return df.exceptAll(literal(df, row))


def update(df: DataFrame, old: tuple, new: tuple) -> DataFrame:
    """One row equal to `old` becomes `new`; nothing if there is none."""
    gone = literal(df, old)
    hit = df.alias("a").join(gone.alias("b"), null_safe("a", "b", df.columns), "left_semi").limit(1)
    return df.exceptAll(gone).unionByName(hit.select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(new, df.schema)]))


def split(df: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """The first half, of floor(n / 2) rows, and the second."""
    placed = with_position(df, order, "_pos")
    n = placed.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return placed.where(F.col("_pos") < n // 2).drop("_pos"), placed.where(F.col("_pos") >= n // 2).drop("_pos")


def iterate(df: DataFrame, f: Callable[[Row], None]) -> None:
    """A side effect per row, run where the rows are."""
    df.foreach(f)


def project(df: DataFrame, /, **columns: Column) -> DataFrame:
    """map: a record per row."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def keep(df: DataFrame, *predicates: Column) -> DataFrame:
    """filter: rows for which all predicates hold."""
    return reduce(DataFrame.where, predicates, df)


def fold(df: DataFrame, /, **aggregates: Column) -> DataFrame:
    """fold with algebraic accumulators: partial sums before the shuffle."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()])


def group_by(df: DataFrame, keys: list[str], /, **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def fold_ordered(df: DataFrame, keys: list[str], order: list[str], column: str, zero, step: Callable, out: str, kind: T.DataType) -> DataFrame:
    """Per group, step(... step(zero, x1) ..., xn) over the column in the given order, for accumulators that have no merge.

    Each group streams through its task in order with one accumulator; it is never collected, however large. Null values reach `step` as
    None.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, acc, has = None, zero, False
        for batch in batches:
            done = []
            values = batch[column].astype(object).where(batch[column].notna(), None)
            names = [batch[k].astype(object).where(batch[k].notna(), None) for k in keys]
            for *key, x in zip(*names, values):
                if has and key != current:
                    done.append([*current, acc])
                    acc = zero
                current, has = key, True
                acc = step(acc, x)
            if done:
                yield pd.DataFrame(done, columns=schema.names)
        if has:
            yield pd.DataFrame([[*current, acc]], columns=schema.names)

    sorted_rows = df.select(*dict.fromkeys([*keys, *_order(order), column])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInPandas(run, schema)


def group_by_contiguous(df: DataFrame, key: Column, slots: int, zero: dict, /, **aggregates: Column) -> DataFrame:
    """(key, aggregates) for each slot from 0 to slots - 1, `zero` where a slot has no rows; keys outside are dropped, as a
    table of that many slots has no place for them."""
    grouped = df.groupBy(key.cast("long").alias("key")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.sparkSession.range(slots).withColumnRenamed("id", "key").join(grouped, "key", "left").select("key", *[F.coalesce(F.col(n), F.lit(zero[n])).alias(n) for n in aggregates])


def ext(df: DataFrame, items: Column, name: str, *carry: str) -> DataFrame:
    """Flat map: one row per element of an array expression; none for an empty or null array."""
    return df.select(*carry, F.explode(items).alias(name))


def sort(df: DataFrame, order: list) -> DataFrame:
    return df.orderBy(*_order(order))


def split_many(df: DataFrame, order: list, n: int) -> DataFrame:
    """Rows with the chunk of n rows that they belong to."""
    return with_position(df, order, "_pos").withColumn("chunk", F.expr(f"_pos div {n}")).drop("_pos")


def fused_join_fold(outer: DataFrame, inner: DataFrame, on: Column, *aggregates: Column) -> DataFrame:
    """Index join fused with a fold: aggregates over the matches of each outer row with its entry in a map."""
    return outer.join(inner, on).agg(*aggregates)


_MERGED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}


def running(df: DataFrame, keys: list[str], order: list[str], merge: dict[str, str] | None = None, share: float = 0.005, /, **aggregates: Column) -> DataFrame:
    """Prefix folds: each row with aggregates over its group up to it.

    merge says of each aggregate how its values over two runs of rows make that over both: sum, min or max. With it, keys that may hold `share` of the rows
    (found by sketch) go by ranges of key and order, and what a range leaves is carried into the next, so no task holds all rows of a hot key. Without it
    each key has one task. Among equal orders any row may come first. Null keys are values.
    """
    names = list(aggregates)

    def over(*by: str) -> dict[str, Column]:
        window = W.partitionBy(*by).orderBy(*_order(order), *(["_tie"] if "_part" in by else [])).rowsBetween(W.unboundedPreceding, W.currentRow)
        return {n: c.over(window) for n, c in aggregates.items()}

    if merge is None:
        return df.withColumns(over(*keys))
    if set(merge) != set(aggregates) or not set(merge.values()) <= set(_MERGED):
        raise ValueError("merge names sum, min or max for each aggregate")
    from sparkloom.operators.heavy import heavy_keys
    from sparkloom.session import cut

    hot = heavy_keys(df, keys, share).select(*keys)
    found = hot.collect()  # at most 2 / share keys
    if not found:
        return df.withColumns(over(*keys))
    marks = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    cold = df.alias("a").join(marks.alias("h"), null_safe("a", "h", keys), "left_anti").withColumns(over(*keys))
    ranged = df.alias("a").join(marks.alias("h"), null_safe("a", "h", keys), "left_semi").withColumn("_tie", F.monotonically_increasing_id())
    rows = cut(ranged.repartitionByRange(*keys, *_order(order), "_tie").withColumn("_part", F.spark_partition_id()))
    # only the last key of a range may go on in the next; what it leaves is merged along the ranges
    key = F.struct(*keys)
    ends = rows.groupBy("_part", *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    ends = ends.groupBy("_part").agg(F.max_by(F.struct(key.alias("key"), *names), key).alias("last")).select("_part", "last.*")
    carried = ends.select(F.expr("lead(_part) OVER (ORDER BY _part)").alias("_part"), "key.*", *[F.expr(f"{merge[n]}(`{n}`) OVER (PARTITION BY key ORDER BY _part)").alias(f"_carry_{i}") for i, n in enumerate(names)])
    local = rows.withColumns(over("_part", *keys)).alias("a").join(F.broadcast(carried).alias("b"), null_safe("a", "b", ["_part", *keys]), "left")
    both = local.select(*[F.col(f"a.{c}") for c in df.columns], *[_MERGED[merge[n]](F.col(f"a.{n}"), F.col(f"b._carry_{i}")).alias(n) for i, n in enumerate(names)])
    return cold.unionByName(both)
