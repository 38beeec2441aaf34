"""Iterative graph analytics as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from sparkloom.session import cut


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(vertex, rank) after a number of rounds over distinct edges (src, dst).

    Ranks start at 1 / n. A vertex passes (1 - damping) / n + damping * rank, divided by its out-degree, along each edge; what vertices without edges
    pass is spread evenly over all: that is 1 less what arrives along edges, as ranks sum to 1. Edges with a null end only name a vertex. Edges
    stay partitioned by source; lineage is cut in each round in the shared folder, so plans stay those of one round.
    """
    pairs = edges.select("src", "dst").dropna().distinct()
    vertices = edges.select(F.col("src").alias("vertex")).unionByName(edges.select(F.col("dst").alias("vertex"))).dropna().distinct()
    degree = pairs.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
    vertices = cut(vertices.join(degree, "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")))
    pairs = cut(pairs.repartition("src"))
    n = vertices.count()
    if not n:
        return vertices.select("vertex", F.lit(0.0).alias("rank")).limit(0)
    base = (1 - damping) / n
    ranks = vertices.select("vertex", "degree", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        out = ranks.where("degree > 0").select(F.col("vertex").alias("src"), ((F.lit(base) + F.lit(damping) * F.col("rank")) / F.col("degree")).alias("out"))
        arriving = pairs.join(out, "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum("out").alias("arrived"))
        seen = Observation()  # the sum comes with the run that cuts
        arrived = vertices.join(arriving, "vertex", "left").select("vertex", "degree", F.coalesce("arrived", F.lit(0.0)).alias("arrived"))
        arrived = cut(arrived.observe(seen, F.sum("arrived").alias("sum")))
        lost = 1.0 - seen.get["sum"]
        ranks = arrived.select("vertex", "degree", (F.col("arrived") + F.lit(lost / n)).alias("rank"))
    return ranks.select("vertex", "rank")


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.dropna().groupBy(F.col("dst").alias("vertex")).agg(F.count(F.lit(1)).alias("links"))
