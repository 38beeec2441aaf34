"""Join strategies and what the distributed programs of the collection algebra need besides: partitioning, statistics, as-of and multi-way joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from sparkloom.operators.arrowtools import fresh
from sparkloom.operators.bag import null_safe
from sparkloom.operators.heavy import heavy_keys, skew_join
from sparkloom.operators.sizes import BROADCAST_BYTES, fits_broadcast, measured_width, planned_bytes
from sparkloom.session import cut

def hash_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Both sides shuffled by key, a table built from the right."""
    return left.join(right.hint("shuffle_hash"), keys, how)


def broadcast_join(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """The right side goes to all executors if it has at most `most` bytes; a larger one takes the shuffle."""
    return left.join(F.broadcast(right) if fits_broadcast(right, most) else right, on, how)


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", most: int = BROADCAST_BYTES, product: bool = False) -> DataFrame:
    """Join on any predicate. Equal conjuncts take a shuffle if the right side is over `most` bytes; without any, comparing each pair of a large right
    side is refused unless `product` asks for it."""
    joined = broadcast_join(left, right, on, how, most)
    if not product and not fits_broadcast(right, most):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            raise ValueError("no equality in the predicate and the right side is too large to broadcast; see ordered.pairs_between, or product=True")
    return joined


def partition_by_key(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def partition_round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def partition_statistics(df: DataFrame) -> DataFrame:
    """(partition, n) of the partitions that have rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def collection_statistics(named: dict[str, DataFrame]) -> DataFrame:
    """(collection, n) of several collections."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in named.items()])


def key_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, strict: bool = False, share: float = 0.005) -> DataFrame:
    """Each left row with the right row of its key that is the newest at or (strict) before its own; nulls if there is none.

    Both sides are united, sorted within their key and the last right row carried along: one shuffle, no pairs. Keys that may hold `share`
    of the united rows (found by sketch) go by ranges of key and place instead, so that their rows spread over many tasks, and the last
    right row of a range is carried into the next. If several right rows of a key stand at one place, that with the greatest other columns
    counts. Null keys match nothing. A column of right named like one of left, letter case aside, gets the suffix _2.
    """
    known = reduce(Column.__and__, [F.col(b).isNotNull() for b in by])
    cols = [c for c in right.columns if c not in by]
    taken = {c.lower() for c in left.columns}
    names = [fresh(c, taken) for c in cols]
    r = right.groupBy(*by, F.col(right_at).alias("_at")).agg(F.max(F.struct(*cols)).alias("_right")).withColumn("_left", F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType))
    l = left.where(known).select(*by, F.col(left_at).alias("_at"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    # with equal places the right row comes first unless it must be strictly older
    rank = F.when(F.col("_left").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    keys = ", ".join(f"`{b}`" for b in by)
    rows = r.where(known).unionByName(l).withColumn("_rank", rank)
    hot = heavy_keys(left.select(*by).unionByName(right.select(*by)).where(known), by, share).select(*by)
    found = hot.collect()  # at most 2 / share keys
    near = F.expr(f"last(_right, true) OVER (PARTITION BY {keys} ORDER BY _at, _rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    if not found:
        carried = rows.withColumn("_near", near)
    else:
        marks = F.broadcast(hot.sparkSession.createDataFrame(found, hot.schema))
        cold = rows.join(marks, by, "left_anti").withColumn("_near", near)
        carried = cold.unionByName(_carried_over_ranges(rows.join(marks, by, "left_semi"), by).select(*cold.columns))
    out = carried.where("_left IS NOT NULL").select("_left.*", *[F.col(f"_near.`{c}`").alias(n) for c, n in zip(cols, names)])
    alone = left.where(~known).select("*", *[F.lit(None).cast(out.schema[n].dataType).alias(n) for n in names])
    return out.unionByName(alone)


def _carried_over_ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """`_near` of rows (by..., _at, _rank, _right, _left) by ranges of key and place; between ranges goes a row each."""
    keys = ", ".join(f"`{b}`" for b in by)
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, "_at", "_rank", "_tie")
    rows = cut(spread.withColumn("_part", F.spark_partition_id()))
    local = rows.withColumn("_near", F.expr(f"last(_right, true) OVER (PARTITION BY _part, {keys} ORDER BY _at, _rank, _tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    # the last key of each range is the only one that may go on in the next; its last right row, or that of ranges before
    key = F.struct(*by)
    at = F.struct("_at", "_rank", "_tie")
    ends = rows.groupBy("_part", *by).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), at)).alias("_end"))
    ends = ends.groupBy("_part").agg(F.max_by(F.struct(key.alias("key"), "_end"), key).alias("_last")).select("_part", "_last.key", "_last._end")
    ends = ends.withColumn("_carry", F.expr("last(_end, true) OVER (PARTITION BY key ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    # what a range leaves goes to the next range that has rows
    ends = ends.select(F.expr("lead(_part) OVER (ORDER BY _part)").alias("_part"), "key.*", "_carry")
    carried = local.alias("a").join(F.broadcast(ends).alias("b"), null_safe("a", "b", ["_part", *by]), "left")
    return carried.select("a.*", "b._carry").withColumn("_near", F.coalesce("_near", "_carry")).drop("_carry")


def multiway(relations: list[DataFrame], conditions: list[list[str]], multiplicity: str = "mult") -> DataFrame:
    """Relations with multiplicities joined one after another on shared columns; multiplicities multiply.

    conditions[i] are the columns shared with what is joined before relation i + 1. The optimizer reorders inner joins.
    """
    out = relations[0].withColumnRenamed(multiplicity, "_m0")
    for i, (r, keys) in enumerate(zip(relations[1:], conditions), 1):
        out = out.join(r.withColumnRenamed(multiplicity, f"_m{i}"), keys)
    product = reduce(Column.__mul__, [F.col(f"_m{i}") for i in range(len(relations))])
    return out.withColumn(multiplicity, product).drop(*[f"_m{i}" for i in range(len(relations))])


def collapse(df: DataFrame, multiplicity: str = "mult") -> DataFrame:
    """Equal rows as one with the sum of their multiplicities; rows that cancel are gone."""
    rest = [c for c in df.columns if c != multiplicity]
    return df.groupBy(*rest).agg(F.sum(multiplicity).alias(multiplicity)).where(F.col(multiplicity) != 0)


def with_multiplicity(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("mult"))


def preaggregated_join(many: DataFrame, one: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per key before the join instead of after, where only the key is needed from the many side."""
    return many.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).join(one, keys)


def select_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = 0.05) -> DataFrame:
    """The join by what the sides are: the right side is broadcast if it fits, keys that may hold `share` of the left rows take `skew_join`, else both
    sides are shuffled by key."""
    if fits_broadcast(right):
        return left.join(F.broadcast(right), keys, how)
    if how in ("inner", "left") and not heavy_keys(left.select(*keys).dropna(), keys, share).isEmpty():
        return skew_join(left, right, keys, how, share)
    return hash_join(left, right, keys, how)


def ordered_multiway(relations: list[DataFrame], multiplicity: str = "mult") -> DataFrame:
    """`multiway` in an order of its own: from the relation of fewest planned bytes, always the smallest that shares a column with what is joined.

    Relations are joined on the columns they share; ValueError if one shares none with the others, as its join would be a product.
    """
    left = sorted(relations, key=planned_bytes)
    chosen, conditions = [left.pop(0)], []
    have = set(chosen[0].columns) - {multiplicity}
    while left:
        fit = next((r for r in left if have & set(r.columns)), None)
        if fit is None:
            raise ValueError("a relation shares no column with the others")
        left.remove(fit)
        conditions.append(sorted(have & set(fit.columns)))
        chosen.append(fit)
        have |= set(fit.columns) - {multiplicity}
    return multiway(chosen, conditions, multiplicity)


def staged(df: DataFrame, name: str) -> DataFrame:
    """An intermediate result computed once, written to the shared folder and known to SQL under a name."""
    made = cut(df)
    made.createOrReplaceTempView(name)
    return made


class Pinned:
    """A read-only value that the Python workers of a process share: it is sent once to each executor, and made from that once in each worker.

    `make` runs over the sent value when `get` is first called in a process; the sent value must be small, as it goes everywhere.
    """

    _made: dict[str, object] = {}

    def __init__(self, df: DataFrame, value, make: Callable = lambda v: v):
        self._sent, self._make = df.sparkSession.sparkContext.broadcast(value), make
        self._key = uuid.uuid4().hex

    def get(self):
        if self._key not in Pinned._made:
            Pinned._made[self._key] = self._make(self._sent.value)
        return Pinned._made[self._key]


def profiled(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df` and what its next run says of it: `observation.get` gives rows and bytes, counted on the way."""
    seen = Observation(name)
    width = measured_width(df)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")), seen


def plan_lines(df: DataFrame) -> DataFrame:
    """The physical plan, a row a line, for logs."""
    lines = df._jdf.queryExecution().executedPlan().toString().rstrip().split("\n")
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "line int, text string")
