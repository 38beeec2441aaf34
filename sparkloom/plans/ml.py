"""Iterative learning over vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.functions.arrays import distance
from sparkloom.session import cut


def _literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def nearest_mean(vector: Column, means: list[list[float]]) -> Column:
    """Place of the nearest mean; the first of equal ones."""
    scored = F.array(*[F.struct(distance(vector, _literal(m)).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(means)])
    return F.array_min(scored)["i"]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a matrix from a list column; ValueError for nulls and other lengths."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * dims:
        raise ValueError(f"vectors must have {dims} numbers each")
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def mean_sums(points: DataFrame, vector: str, means: list[list[float]]) -> DataFrame:
    """(m, n, sums): points nearest to each mean, and their elementwise sums; the first of equally near means counts.

    Distances are those of whole Arrow batches at once, and a partition gives a row per mean, so hardly anything is shuffled.
    """
    centre = np.array(means, dtype=float)
    k, dims = centre.shape
    schema = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), dims)
            near = np.stack([((x - c) ** 2).sum(axis=1) for c in centre]).argmin(axis=0)
            count += np.bincount(near, minlength=k)
            np.add.at(total, near, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=schema.names)

    parts = points.select(vector).mapInArrow(run, schema)
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("m").agg(F.sum("n").alias("n"), *sums).select("m", "n", F.array(*[f"s{i}" for i in range(dims)]).alias("sums"))


def kmeans(df: DataFrame, key: str, vector: str, k: int = 5, iterations: int = 5) -> list[list[float]]:
    """Lloyd's rounds from the first k points by key. k means, no points, reach the driver. A mean that loses all points stays."""
    means = [list(r[vector]) for r in df.orderBy(key).select(vector).take(k)]
    points = cut(df.select(vector))
    for _ in range(iterations if means else 0):
        for r in mean_sums(points, vector, means).collect():
            means[r.m] = [x / r.n for x in r.sums]
    return means


def naive_bayes(df: DataFrame, label: str, vector: str, smoothing: float = 1.0) -> DataFrame:
    """(label, pi, i, theta): log prior and log likelihood per label and feature, multinomial with additive smoothing. Features are not negative."""
    sums = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.sum(F.col("x").cast("decimal(28,10)")).cast("double").alias("s"))
    per_label = sums.groupBy(label).agg(F.sum(F.col("s").cast("decimal(28,10)")).cast("double").alias("all"), F.count(F.lit(1)).alias("features"))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg((F.sum("n") + F.count(F.lit(1)) * smoothing).alias("d"))
    model = sums.join(per_label, label).join(counts, label)
    return model.select(
        label, (F.log(F.col("n") + smoothing) - F.log(everything.scalar())).alias("pi"), "i",
        (F.log(F.col("s") + smoothing) - F.log(F.col("all") + F.col("features") * smoothing)).alias("theta"),
    )


def sgd_svm(
    df: DataFrame, key: str, vector: str, label: str, dims: int, iterations: int = 10, step: float = 0.1, penalty: float = 0.001, shards: int = 8, batch: int = 1024
) -> tuple[list[float], list[float]]:
    """(weights, loss per round) of a linear support vector machine by stochastic descent in mini-batches. Labels are -1 and 1.

    Rows belong to the shard pmod(key, shards) for ever, whatever the partitioning, and keep the order of their keys in it. In each round every shard descends through
    its mini-batches of `batch` rows from the shared weights, the results of the shards are averaged, and the step shrinks by 0.95. One weight
    vector per shard moves; choose as many shards as there are cores.
    """
    data = cut(df.select(F.pmod(F.col(key), F.lit(shards)).cast("int").alias("_shard"), key, vector, F.col(label).cast("double").alias("_y")).repartition(shards, "_shard").sortWithinPartitions("_shard", key))
    w = np.zeros(dims)
    losses = []
    schema = T.StructType([T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())])

    def descend(start: np.ndarray, rate: float):
        def move(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            short = y * (x @ p) < 1
            return p - rate * (penalty * p - (y[short, None] * x[short]).sum(axis=0) / len(y))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, p, loss, n = None, start, 0.0, 0
            held_x, held_y = np.zeros((0, dims)), np.zeros(0)

            def close() -> pa.RecordBatch:
                q = move(p, held_x, held_y) if len(held_y) else p
                return pa.RecordBatch.from_arrays([pa.array([q.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())], names=schema.names)

            for b in batches:
                if not b.num_rows:
                    continue
                shards_, all_x, all_y = b.column(0).to_numpy(), _vectors(b.column(1), dims), b.column(2).to_numpy()
                ends = np.append(np.flatnonzero(np.diff(shards_)) + 1, len(shards_))
                for lo, hi in zip(np.append(0, ends[:-1]), ends):
                    if shards_[lo] != shard:
                        if n:
                            yield close()
                        shard, p, loss, n = shards_[lo], start, 0.0, 0
                        held_x, held_y = np.zeros((0, dims)), np.zeros(0)
                    x, y = all_x[lo:hi], all_y[lo:hi]
                    loss += float(np.maximum(0.0, 1 - y * (x @ start)).sum())
                    n += len(y)
                    held_x, held_y = np.concatenate([held_x, x]), np.concatenate([held_y, y])
                    while len(held_y) >= batch:
                        p = move(p, held_x[:batch], held_y[:batch])
                        held_x, held_y = held_x[batch:], held_y[batch:]
            if n:
                yield close()

        return run

    def loss_of(parts: list) -> float:
        rows = sum(r.n for r in parts)
        return sum(r.loss for r in parts) / rows + penalty * float(w @ w) if rows else math.nan

    for i in range(iterations + 1):  # the last pass only gives the loss of the final weights
        parts = data.select("_shard", vector, "_y").mapInArrow(descend(w.copy(), step), schema).collect()  # a row per shard
        if i:
            losses.append(loss_of(parts))
        if parts and i < iterations:
            w = np.mean([r.w for r in parts], axis=0)
        step *= 0.95
    return w.tolist(), losses


def autoencoder(df: DataFrame, key: str, vector: str, dims: int, hidden: int = 8, iterations: int = 10, step: float = 0.05, shards: int = 8, batch: int = 256) -> tuple[list[np.ndarray], list[float]]:
    """(weights in and out, mean squared error per round) of a network with one hidden layer of tanh that learns to give its input back.

    Back-propagation in mini-batches as in `sgd_svm`: rows keep their shard pmod(key, shards) and its order, every shard descends from the shared weights, and the
    shards' weights are averaged. First weights depend on nothing but the sizes.
    """
    data = cut(df.select(F.pmod(F.col(key), F.lit(shards)).cast("int").alias("_shard"), key, vector).repartition(shards, "_shard").sortWithinPartitions("_shard", key))
    r = np.random.default_rng(0)
    weights = [r.normal(0, dims**-0.5, (dims, hidden)), r.normal(0, hidden**-0.5, (hidden, dims))]
    losses = []
    schema = T.StructType([T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())])

    def learn(start: list[np.ndarray]):
        def move(w: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
            h = np.tanh(x @ w[0])
            wrong = h @ w[1] - x
            back = (wrong @ w[1].T) * (1 - h * h)
            return [w[0] - step * x.T @ back / len(x), w[1] - step * h.T @ wrong / len(x)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, []

            def close() -> pa.RecordBatch:
                x = np.concatenate(held)
                loss = float(((np.tanh(x @ start[0]) @ start[1] - x) ** 2).mean(axis=1).sum())
                w = start
                for lo in range(0, len(x), batch):
                    w = move(w, x[lo : lo + batch])
                return pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.ravel() for v in w]).tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([len(x)], pa.int64())], names=schema.names)

            for b in batches:
                if not b.num_rows:
                    continue
                s, x = b.column(0).to_numpy(), _vectors(b.column(1), dims)
                ends = np.append(np.flatnonzero(np.diff(s)) + 1, len(s))
                for lo, hi in zip(np.append(0, ends[:-1]), ends):
                    if s[lo] != shard and held:
                        yield close()
                        held = []
                    shard = s[lo]
                    held.append(x[lo:hi])
            if held:
                yield close()

        return run

    for _ in range(iterations):
        parts = data.select("_shard", vector).mapInArrow(learn([w.copy() for w in weights]), schema).collect()  # a row per shard
        if not parts:
            break
        losses.append(sum(p.loss for p in parts) / sum(p.n for p in parts))
        flat = np.mean([p.w for p in parts], axis=0)
        weights = [flat[: dims * hidden].reshape(dims, hidden), flat[dims * hidden :].reshape(hidden, dims)]
    return weights, losses
