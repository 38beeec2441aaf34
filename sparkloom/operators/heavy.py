"""Per-key work when a few keys hold most rows: finding them, aggregating and joining without one task doing it all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.sizes import BROADCAST_BYTES, measured_bytes

TRACKED = 16384  # items of the sketch; its error is at most 3.5 / TRACKED of the rows


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys..., estimate) of every key combination that may hold at least `share` of the rows; at most 2 / share rows.

    A frequent-items sketch built inside the executors finds them. Its estimates are off by 3.5 / TRACKED of the
    rows at most, so none above the share is missed; a few a little below may be among them. Null keys count.
    """
    if not 8 / TRACKED <= share <= 1:
        raise ValueError(f"share must be from {8 / TRACKED} to 1")
    # every item whose estimate can reach the share fits into k places
    k = int(1 / (share - 3.5 / TRACKED)) + 1
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    top = df.select(packed.alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.expr(f"approx_top_k(_key, {k}, {TRACKED})").alias("_top"))
    rows = top.select("_n", F.explode("_top").alias("_t")).where(F.col("_t.count") >= F.col("_n") * (share - 3.5 / TRACKED))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[c] for c in keys))
    return rows.select(F.from_json("_t.item", schema).alias("_k"), F.col("_t.count").alias("estimate")).select("_k.*", "estimate")


def skew_aggregate(df: DataFrame, keys: list[str], partial: dict[str, Column], merge: dict[str, Callable[[str], Column]], share: float = 0.005, heavy: DataFrame | None = None) -> DataFrame:
    """One row per key combination with aggregates, heavy keys apart from the rest.

    partial: name -> aggregate over rows; merge: name -> aggregate over partial values, for example
    {"n": F.count("x")} with {"n": F.sum}. Heavy keys, found by sketch (`heavy_keys`, at most 2 / share rows, hence fit
    to broadcast), are taken out by a broadcast join; their rows are combined under a salt and then merged. The other
    keys take one ordinary shuffle. The parts are disjoint and their union is the result; nothing is sampled or dropped.
    Null key fields are values. Repeated rows count. An empty table gives an empty one. Columns that don't matter are dropped
    before the shuffle.
    """
    if keys_clash := {*partial} & {*keys}:
        raise ValueError(f"aggregates named like keys: {keys_clash}")
    heavy = heavy_keys(df, keys, share) if heavy is None else heavy
    marks = F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy")).distinct())
    marked = df.alias("l").join(marks.alias("h"), _pairs(keys), "left").select("l.*", "h._heavy")
    light = marked.where(F.col("_heavy").isNull()).groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()])
    salted = marked.where(F.col("_heavy")).groupBy(*keys, F.spark_partition_id().alias("_salt")).agg(*[c.alias(n) for n, c in partial.items()])
    hot = salted.groupBy(*keys).agg(*[merge[n](n).alias(n) for n in partial])
    return light.unionByName(hot)


def _pairs(keys: list[str]) -> Column:
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}"))
    return on


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = 0.005, most: int = BROADCAST_BYTES) -> DataFrame:
    """left JOIN right on keys (inner or left), with the heavy keys of `left` on a way of their own.

    The rows of `right` with heavy keys are broadcast if they have at most `most` bytes; if they have more, they are
    spread: each left row takes one of 16 salts and each right row all of them. Other keys take an ordinary
    shuffle join. Columns: keys, then the rest of left and of right; a column of right named like one of left gets the suffix _r. Null keys
    match nothing. Repeated rows multiply as in any join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    names = {c.lower() for c in left.columns}
    right = right.select(*keys, *[F.col(c).alias(c + "_r" if c.lower() in names else c) for c in right.columns if c not in keys])
    marks = F.broadcast(heavy_keys(left.dropna(subset=keys), keys, share).select(*keys, F.lit(True).alias("_heavy")))
    marked = left.join(marks, keys, "left")
    hot_right = right.join(marks, keys, "left_semi")
    hot, cold = marked.where(F.col("_heavy")).drop("_heavy"), marked.where(F.col("_heavy").isNull()).drop("_heavy")
    if measured_bytes(hot_right) <= most:
        joined = hot.join(F.broadcast(hot_right), keys, how)
    else:
        salts = 16
        spread = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = hot.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")
    return joined.unionByName(cold.join(right, keys, how))
