"""Filling containers of fixed capacity with texts, measured in tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.llm.tokens import VOCABULARY, text_tokens, with_token_count
from sparkloom.operators.arrowtools import arrow_schema, map_arrow, text_array
from sparkloom.session import cut

CAPACITY = 2048
SALTS = 64  # at least; there are more for more items
ITEMS_A_SALT = 1_000_000


@dataclass
class Plan:
    """Where items go, by length alone: items of a length, numbered from 0, fall into intervals, and each interval fills one
    place in each of a run of containers. As items of one length are alike, this says everything."""

    capacity: int
    containers: int = 0
    # (length, first item, containers in the run, first container)
    intervals: list[tuple[int, int, int, int]] = field(default_factory=list)
    # first container of a run -> room left in each
    room: dict[int, int] = field(default_factory=dict)
    used: Counter = field(default_factory=Counter)

    def place(self, length: int, count: int, base: int) -> None:
        self.intervals.append((length, self.used[length], count, base))
        self.used[length] += count

    def open(self, count: int) -> int:
        base, self.containers = self.containers, self.containers + count
        return base


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Containers for `counts` items of each length from 1 to `capacity`.

    First exact fills: for each length, from the longest, single lengths, pairs and triples that sum to exactly what is left of a
    container are looked up by their sum and consumed as often as the counts allow. Each step uses up a length, so there are at most as many
    steps as lengths and `plan` grows with the capacity, never with the items. Then the rest, longest first, into the
    open container with the least room that suffices, or new ones.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        have[length] += n
    plan = Plan(capacity)
    pairs: dict[int, tuple[int, int] | None] = {}

    def fits(combo: tuple[int, ...]) -> int:
        """How many times the counts allow the combination."""
        return min(int(have[x]) // k for x, k in Counter(combo).items())

    def pair(total: int, first: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of that sum. Counts only fall, so a sum without a pair stays so."""
        known = pairs.get(total, ())
        if known is None:
            return None
        if known and fits(first + known):
            return known
        a = np.arange((total + 1) // 2, min(total - 1, capacity) + 1)
        a = a[(have[a] > 0) & (have[total - a] > 0)]
        for x in a.tolist():
            if fits(first + (x, total - x)):
                pairs[total] = (x, total - x)
                return pairs[total]
        if not len(a):
            pairs[total] = None
        return None

    def complement(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if gap == 0:
            return ()
        if have[gap] and fits((length, gap)):
            return (gap,)
        if gap >= 2 and (two := pair(gap, (length,))):
            return two
        for third in np.flatnonzero(have[: max(gap - 1, 0)])[::-1].tolist():
            if fits((length, third)) and (two := pair(gap - third, (length, third))):
                return (third, *two)
        return None

    for length in range(capacity, 0, -1):
        while have[length] and (rest := complement(length)) is not None:
            combo = (length, *rest)
            n = fits(combo)
            base = plan.open(n)
            plan.room[base] = 0
            for x in combo:
                plan.place(x, n, base)
                have[x] -= n

    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def put(gap: int, base: int, n: int) -> None:
        plan.room[base] = gap
        if gap:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((base, n))

    for length in range(capacity, 0, -1):
        while left := int(have[length]):
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                base, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[i]
                q = min(n, left)
                if q < n:
                    put(gap, base + q, n - q)
            else:
                gap, q = capacity, -(-left // (capacity // length))
                base = plan.open(q)
            plan.place(length, q, base)
            have[length] -= q
            put(gap - length, base, q)
    return plan


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(container, key, part, first_token, n_tokens, unused): every text in containers of `capacity` tokens.

    A text stays whole unless it has more tokens than the capacity; then its parts hold `capacity` tokens each and the last
    the rest, part counting from 0. unused is the room left in the container. Null and empty texts have 0 tokens and are spread
    over the containers; if there are no others, container 0 holds them all. Repeated rows are items of their own. A null key
    is kept. An empty table gives an empty one. Of other columns nothing is kept.

    Method: exact-complement hashing on the counts per length (`plan_packing`), at most capacity + 1 numbers at the driver. Items
    then get numbers within their length, under salts, so that a length that many items share is spread, and look up
    their container in the plan.
    """
    k = "_key"
    sized = with_token_count(df.select(F.col(key).alias(k), F.col(text).alias("_text")), [k], "_text", "n", path)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity))
    items = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    items = items.withColumns({"first_token": F.col("part") * capacity, "length": F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * capacity), "id": F.monotonically_increasing_id()})
    items = cut(items.select(k, "part", "first_token", "length", "id"))
    salts = max(SALTS, items.count() // ITEMS_A_SALT)
    items = items.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    sizes = items.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    plan = plan_packing({n: c for n, c in histogram.items() if n}, capacity)
    offsets = sizes.withColumn("offset", F.expr("sum(n) OVER (PARTITION BY length ORDER BY salt) - n")).select("length", "salt", "offset")
    ranked = items.withColumn("place", F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY id)")).join(offsets, ["length", "salt"])
    ranked = ranked.select(k, "part", "first_token", "length", (F.col("offset") + F.col("place") - 1).alias("rank"))

    at = np.array(sorted(plan.intervals), dtype=np.int64).reshape(-1, 4)
    run = np.array(sorted(plan.room), dtype=np.int64)
    room = np.array([plan.room[b] for b in run.tolist()], dtype=np.int64)
    containers = plan.containers
    schema = T.StructType([T.StructField("container", T.LongType()), T.StructField(k, df.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("part", "first_token", "n_tokens", "unused")]])
    target = arrow_schema(schema)
    width = int(max(histogram.values(), default=0)) + 1

    def assign(batch: pa.RecordBatch):
        length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        container = np.zeros(len(length), dtype=np.int64)
        some = length > 0
        i = np.searchsorted(at[:, 0] * width + at[:, 1], length[some] * width + rank[some], "right") - 1
        container[some] = at[i, 3] + rank[some] - at[i, 1]
        container[~some] = rank[~some] % max(containers, 1)
        left = room[np.searchsorted(run, container, "right") - 1] if len(run) else np.full(len(container), capacity)
        yield from pa.table([pa.array(container), batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(left)], names=target.names).cast(target).to_batches()

    return map_arrow(ranked, assign, schema).withColumnRenamed(k, key)


def container_pieces(df: DataFrame, key: str, text: str, packed: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(container, key, part, piece): the bytes of text that each part of `packed`, a result of `pack_texts`, puts into its container.

    Keys must be unique and not null. A part may end inside a character, so pieces are bytes; those of a text, one after another, are
    the text. Each text is read once, with all its parts. Null and empty texts have one empty piece.
    """
    spans = packed.groupBy(key).agg(F.collect_list(F.struct("container", "part", "first_token", "n_tokens")).alias("_spans"))
    joined = spans.join(df.select(key, F.col(text).cast("string").alias("_text")), key).select(key, "_spans", "_text")
    schema = T.StructType([T.StructField("container", T.LongType()), df.schema[key], T.StructField("part", T.LongType()), T.StructField("piece", T.BinaryType())])
    target = arrow_schema(schema)

    def slice_texts(batch: pa.RecordBatch):
        rows, containers, parts, pieces = [], [], [], []
        for i, (spans, t) in enumerate(zip(batch.column(1).to_pylist(), text_array(batch.column(2)).to_pylist())):
            token_bytes = text_tokens(t, path)
            for s in spans:
                rows.append(i)
                containers.append(s["container"])
                parts.append(s["part"])
                pieces.append(b"".join(token_bytes[s["first_token"] : s["first_token"] + s["n_tokens"]]))
        yield from pa.table([pa.array(containers, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int64()), pa.array(pieces, pa.binary())], names=target.names).cast(target).to_batches()

    return map_arrow(joined, slice_texts, schema)
