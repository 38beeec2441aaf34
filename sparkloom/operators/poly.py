"""Tagged-union buffers: rows of several variants in one ordered table (seq, tag, one struct column per variant)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def union(variants: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Buffer from (name, rows, ordering column): tag is the place in the list, seq the value of the ordering column."""
    parts = []
    for tag, (name, df, seq) in enumerate(variants):
        parts.append(df.select(F.col(seq).cast("long").alias("seq"), F.lit(tag).alias("tag"), F.struct(*df.columns).alias(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def variant(buffer: DataFrame, tag: int, name: str) -> DataFrame:
    """Typed access: the rows of one variant."""
    return buffer.where(F.col("tag") == tag).select("seq", f"{name}.*")


def append(buffer: DataFrame, tag: int, name: str, rows: DataFrame, seq: str) -> DataFrame:
    made = rows.select(F.col(seq).cast("long").alias("seq"), F.lit(tag).alias("tag"), F.struct(*rows.columns).alias(name))
    return buffer.unionByName(made, allowMissingColumns=True)


def safe_field(buffer: DataFrame, name: str, field: str, default: Column) -> Column:
    return F.coalesce(F.col(f"{name}.{field}"), default)


def variant_range(buffer: DataFrame, tag: int, name: str, low: int, high: int) -> DataFrame:
    """The rows of a variant with low <= seq < high."""
    return variant(buffer.where((F.col("seq") >= low) & (F.col("seq") < high)), tag, name)


def tag_counts(buffer: DataFrame) -> DataFrame:
    return buffer.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def runs(buffer: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Runs of one tag in the order: (group..., tag, start, end, n) with the first and last seq of each run.

    Within each group, if one is given; otherwise the order is cut into ranges whose runs are joined at the edges,
    so no task sees all rows.
    """
    from sparkloom.session import cut

    group = group or []
    if group:
        by = "PARTITION BY " + ", ".join(group) + " "
        rows = buffer
    else:
        rows = cut(buffer.select("tag", *order).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
        by = "PARTITION BY _part "
    key = [*group] if group else ["_part"]
    o = ", ".join(order)
    marked = rows.withColumn("_new", F.expr(f"CASE WHEN tag = lag(tag) OVER ({by}ORDER BY {o}) THEN 0 ELSE 1 END"))
    numbered = marked.withColumn("_run", F.expr(f"sum(_new) OVER ({by}ORDER BY {o})"))
    local = numbered.groupBy(*key, "_run", "tag").agg(F.min("seq").alias("start"), F.max("seq").alias("end"), F.count(F.lit(1)).alias("n"))
    if group:
        return local.select(*group, "tag", "start", "end", "n")
    edges = local.groupBy("_part").agg(F.max("_run").alias("_last"))
    local = cut(local.join(edges, "_part"))
    # only the first and last run of a partition can join a neighbour; there are two a partition at most
    inner = local.where((F.col("_run") > 1) & (F.col("_run") < F.col("_last")))
    border = local.where((F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
    border = border.withColumn("_new", F.expr("CASE WHEN tag = lag(tag) OVER (ORDER BY _part, _run) AND _run = 1 THEN 0 ELSE 1 END"))
    border = border.withColumn("_g", F.expr("sum(_new) OVER (ORDER BY _part, _run)"))
    joined = border.groupBy("_g", "tag").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return inner.select("tag", "start", "end", "n").unionByName(joined.select("tag", "start", "end", "n"))


def skip_all(buffer_runs: DataFrame, tag: int, at: int) -> DataFrame:
    """One row: the seq after the run of `tag` that holds `at`, or `at` itself if another variant stands there."""
    hit = buffer_runs.where((F.col("tag") == tag) & (F.col("start") <= at) & (F.col("end") >= at))
    return hit.agg(F.coalesce(F.max("end") + 1, F.lit(at)).cast("long").alias("next"))


def traverse(buffer: DataFrame, group: list[str], order: list[str], step: Callable[[int, int, int], int], low: int | None = None, high: int | None = None) -> DataFrame:
    """(group..., place, seq, tag) of the rows a cursor visits in each group, rows being numbered from 0 in the order.

    The cursor begins at `low` (0 without it); step(tag, place, visits before) is how many rows it goes on, and it ends at `high`, at the end of the group or where a
    step isn't positive. A cursor goes through its group one row after another, so groups, not rows, run side by side; jumps that the
    tags alone decide are `runs` and `skip_all`.
    """
    schema = T.StructType([buffer.schema[c] for c in group] + [T.StructField("place", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("tag", T.IntegerType())])

    def visit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", ignore_index=True)
        end = len(rows) if high is None else min(high, len(rows))
        at, places = low or 0, []
        tags = rows["tag"].tolist()
        while 0 <= at < end:
            places.append(at)
            move = int(step(int(tags[at]), at, len(places) - 1))
            if move <= 0:
                break
            at += move
        return rows.iloc[places].assign(place=places)[[*group, "place", "seq", "tag"]]

    return buffer.select(*dict.fromkeys([*group, *order, "seq", "tag"])).groupBy(*group).applyInPandas(visit, schema)


def byte_size(df: DataFrame) -> DataFrame:
    """Bytes of the rows as JSON text; storage itself is columnar."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).cast("long").alias("bytes"))
