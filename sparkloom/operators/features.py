"""Per-entity feature tables from events, maintained by signed deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkloom.operators.arrowtools import fresh
from sparkloom.operators.bag import null_safe
from sparkloom.operators.heavy import heavy_keys
from sparkloom.operators.wide import scatter_numbers


def signed(events: DataFrame, sign: int) -> DataFrame:
    """Events as deltas: +1 goes in, -1 is taken back."""
    return events.withColumn("sign", F.lit(sign).cast("long"))


def later_arrivals(rows: DataFrame, identity: list[str], order: list[str], share: float = 0.005) -> DataFrame:
    """The rows beyond the first (by `order`, null first) of each identity, with `copies`. Null identity fields are values.

    `rows` has the columns of identity and order. One shuffle by identity numbers the arrivals. Identities that hold a large share of the rows
    (found by sketch, at most 2 / share of them) are kept out of it: their rows are counted with partial sums, and the first of
    each is an aggregate.
    """
    rows = rows.select(*identity, *order)
    hot = F.broadcast(heavy_keys(rows, identity, share).select(*identity, F.lit(True).alias("_hot")))
    marked = rows.alias("a").join(hot.alias("b"), null_safe("a", "b", identity), "left").select("a.*", "b._hot")
    place = F.row_number().over(W.partitionBy(*identity).orderBy(*order))
    light = marked.where(F.col("_hot").isNull()).drop("_hot").withColumn("_n", place).where("_n > 1").drop("_n").withColumn("copies", F.lit(1).cast("long"))
    many = marked.where("_hot").drop("_hot").groupBy(*identity, *order).agg(F.count(F.lit(1)).alias("copies"))
    first = many.groupBy(*identity).agg(F.min(F.struct(*order)).alias("_first"))  # at most as many rows as hot identities
    on = null_safe("a", "b", identity)
    kept = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b._first.{c}")) for c in order])
    rest = many.alias("a").join(F.broadcast(first).alias("b"), on).select("a.*", (F.col("a.copies") - kept.cast("long")).alias("_back"))
    return light.unionByName(rest.where("_back > 0").drop("copies").withColumnRenamed("_back", "copies"))


def _signed(deltas: DataFrame, cell: list[str], time: str) -> DataFrame:
    return deltas.select(*cell, F.col(time).cast("long").alias("time"), F.col("sign").cast("long").alias("sign"))


def apply_deltas(state: DataFrame | None, deltas: DataFrame, entity: list[str], kind: str, source: str, time: str, log: DataFrame | None = None) -> DataFrame:
    """State cells (entity..., kind, source, count, total, last_time) after a batch of signed events.

    Method: counts and totals are added. The latest time rises with inserts; only cells in which a retraction is as late as the latest event
    get their maximum anew, from what is left of `log` (the signed events applied before; needed if there is a state and
    retractions reach that far) and the batch. All sums are partial before the one shuffle, so hot cells are no matter.
    Repeated events count each; an event with a null time counts but has no time; null entity, kind or source are values. Cells that
    fall to a count of 0 vanish. Retracting what was never inserted leaves a negative count, so that a late insert cancels it.
    """
    cell = [*entity, kind, source]
    plain = _signed(deltas, cell, time)
    none = F.lit(None).cast("long")
    rows = plain.select(
        *cell, F.col("sign").alias("n"), (F.col("sign") * F.col("time")).cast("double").alias("t"),
        F.when(F.col("sign") > 0, F.col("time")).alias("up"), F.when(F.col("sign") < 0, F.col("time")).alias("down"),
    )
    if state is not None:
        rows = rows.unionByName(state.select(*cell, F.col("count").alias("n"), F.col("total").alias("t"), F.col("last_time").alias("up"), none.alias("down")))
    merged = rows.groupBy(*cell).agg(F.sum("n").alias("count"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("total"), F.max("up").alias("last_time"), F.max("down").alias("down"))
    merged = merged.where("count != 0").withColumn("stale", F.coalesce(F.col("down") >= F.col("last_time"), F.col("down").isNotNull()))
    sure = merged.where(~F.col("stale")).select(*cell, "count", "total", "last_time")
    stale = merged.where("stale").select(*cell, "count", "total")
    if state is not None and log is None:
        if stale.limit(1).count():
            raise ValueError("retractions reach the latest event of a cell, so the log is needed")
        return sure
    past = plain if log is None else _signed(log, cell, time).unionByName(plain)
    again = past.alias("p").join(stale.alias("s"), null_safe("p", "s", cell), "left_semi")
    net = again.where("time IS NOT NULL").groupBy(*cell, "time").agg(F.sum("sign").alias("sign")).where("sign > 0")
    latest = net.groupBy(*cell).agg(F.max("time").alias("last_time"))
    fixed = stale.alias("s").join(latest.alias("l"), null_safe("s", "l", cell), "left").select("s.*", "l.last_time")
    return sure.unionByName(fixed)


def type_features(cells: DataFrame, entity: list[str], kind: str, source: str) -> DataFrame:
    """(entity..., kind, count, total, last_time, sources): cells summed over sources; a null source is none, a cell with a
    negative count counts as no source."""
    return cells.groupBy(*entity, kind).agg(
        F.sum("count").alias("count"), F.sum("total").alias("total"), F.max("last_time").alias("last_time"),
        F.count(F.when((F.col("count") > 0) & F.col(source).isNotNull(), 1)).alias("sources"),
    )


def feature_table(cells: DataFrame, entity: list[str], kind: str, source: str, kinds: list[str]) -> DataFrame:
    """One row per entity with <kind>__count, <kind>__last_time and <kind>__sources for each of `kinds`.

    Kinds that an entity lacks have a count and sources of 0 and a null last_time; kinds not listed, null ones too, give no
    columns, but their entities a row. Column names that clash, letter case aside, get a suffix. An empty table gives an
    empty one.
    """
    taken = {c.lower() for c in entity}
    values = ["count", "last_time", "sources"]
    names = [[fresh(f"{k}__{v}", taken) for v in values] for k in kinds]
    keys = [f"_e{i}" for i in range(len(entity))]
    per_kind = type_features(cells, entity, kind, source).select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(kind).cast("string").alias("_kind"), *values)
    return scatter_numbers(per_kind, keys, "_kind", values, kinds, names, [0, None, 0]).withColumnsRenamed(dict(zip(keys, entity)))
