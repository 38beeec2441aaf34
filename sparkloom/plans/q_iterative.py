"""Queries of graph and learning workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.plans import graph, ml
from sparkloom.plans.registry import query
from sparkloom.tables import table

ROUNDS = 5


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select(F.col("source_peer").alias("src"), F.col("dest_peer").alias("dst"))


def _pagerank_sql(rounds: int) -> str:
    parts = [
        "e AS (SELECT DISTINCT source_peer AS src, dest_peer AS dst FROM messages WHERE source_peer IS NOT NULL AND dest_peer IS NOT NULL)",
        "n AS (SELECT source_peer AS v FROM messages WHERE source_peer IS NOT NULL UNION SELECT dest_peer FROM messages WHERE dest_peer IS NOT NULL)",
        "g AS (SELECT v, count(dst) AS deg, (SELECT count(*) FROM n) AS c FROM n LEFT JOIN e ON src = v GROUP BY v)",
        "r0 AS (SELECT v, deg, c, 1.0::DOUBLE / c AS rank FROM g)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"o{i} AS (SELECT v, deg, c, (0.15::DOUBLE / c + 0.85::DOUBLE * rank) / greatest(deg, 1) AS o FROM r{i - 1})")
        parts.append(f"""r{i} AS (SELECT g.v, g.deg, g.c, coalesce(a.s, 0) + (SELECT coalesce(sum(o), 0) FROM o{i} WHERE deg = 0) / g.c AS rank FROM g
            LEFT JOIN (SELECT dst, sum(o) AS s FROM e JOIN o{i} ON src = v GROUP BY dst) a ON a.dst = g.v)""")
    return "WITH " + ", ".join(parts) + f" SELECT v AS vertex, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _pagerank_sql(ROUNDS))
def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d), ROUNDS).select("vertex", F.round("rank", 9).alias("rank"))


@query("graph_in_degrees", "SELECT dest_peer AS vertex, count(*) AS links FROM messages WHERE source_peer IS NOT NULL AND dest_peer IS NOT NULL GROUP BY ALL")
def graph_in_degrees(spark, d):
    return graph.in_degrees(_edges(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(
    "kmeans_assign",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT e AS c, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM e ORDER BY vec_id LIMIT 5)
       SELECT vec_id, (arg_min(i, list_distance(e.e, m.c)))::INT AS mean FROM e CROSS JOIN m GROUP BY vec_id""",
)
def kmeans_assign(spark, d):
    v = _vectors(spark, d)
    means = [list(r.e) for r in v.orderBy("vec_id").select("e").take(5)]
    return v.select("vec_id", ml.nearest_mean(F.col("e"), means).alias("mean"))


def _kmeans_sql(rounds: int) -> str:
    parts = [
        "x AS MATERIALIZED (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        "c0 AS MATERIALIZED (SELECT m, i, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS m FROM embeddings ORDER BY vec_id LIMIT 5) USING (vec_id))",
    ]
    near = "a{k} AS MATERIALIZED (SELECT vec_id, arg_min(m, (d, m)) AS m FROM (SELECT vec_id, m, sum((x - c) * (x - c)) AS d FROM x JOIN c{k} USING (i) GROUP BY vec_id, m) GROUP BY vec_id)"
    for k in range(rounds):
        parts += [near.format(k=k), f"c{k + 1} AS MATERIALIZED (SELECT c.m, c.i, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT m, i, avg(x) AS c FROM x JOIN a{k} USING (vec_id) GROUP BY m, i) n ON n.m = c.m AND n.i = c.i)"]
    return f"WITH {', '.join(parts)}, {near.format(k=rounds)} SELECT vec_id, m::INT AS mean FROM a{rounds}"


@query("kmeans", _kmeans_sql(5))
def kmeans(spark, d):
    v = _vectors(spark, d)
    means = ml.kmeans(v, "vec_id", "e")
    return v.select("vec_id", ml.nearest_mean(F.col("e"), means).alias("mean"))


@query(
    "naive_bayes",
    """WITH x AS (SELECT label, unnest(range(0, len(embedding)))::INT AS i, abs(unnest(embedding)::DOUBLE) AS x FROM embeddings), s AS (SELECT label, i, sum(x::DECIMAL(28,10))::DOUBLE AS s FROM x GROUP BY ALL),
       a AS (SELECT label, sum(s::DECIMAL(28,10))::DOUBLE AS total, count(*) AS f FROM s GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL)
       SELECT s.label, s.i, round(ln(n + 1.0) - ln((SELECT sum(n) FROM c) + (SELECT count(*) FROM c) * 1.0), 6) AS pi, round(ln(s + 1.0) - ln(a.total + a.f * 1.0), 6) AS theta FROM s JOIN a USING (label) JOIN c USING (label)""",
)
def naive_bayes(spark, d):
    v = _vectors(spark, d).withColumn("e", F.transform("e", F.abs))
    return ml.naive_bayes(v, "label", "e").select("label", "i", F.round("pi", 6).alias("pi"), F.round("theta", 6).alias("theta"))


def _svm_sql(rounds: int, step: float = 0.1, penalty: float = 0.001) -> str:
    """Each of 8 shards makes one step a round, as its rows fit into a mini-batch."""
    parts = [
        "x AS MATERIALIZED (SELECT vec_id, vec_id % 8 AS s, CASE WHEN label < 5 THEN -1.0 ELSE 1.0 END AS y, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        "w0 AS (SELECT DISTINCT i, 0.0::DOUBLE AS w FROM x)",
    ]
    for k in range(rounds):
        parts += [
            f"m{k} AS MATERIALIZED (SELECT vec_id, any_value(y) * sum(x * w) < 1 AS short FROM x JOIN w{k} USING (i) GROUP BY vec_id)",
            f"g{k} AS (SELECT s, i, sum(CASE WHEN short THEN y * x ELSE 0 END) / count(*) AS g FROM x JOIN m{k} USING (vec_id) GROUP BY s, i)",
            f"w{k + 1} AS MATERIALIZED (SELECT i, avg(w - {step!r}::DOUBLE * ({penalty!r}::DOUBLE * w - g)) AS w FROM w{k} JOIN g{k} USING (i) GROUP BY i)",
        ]
        step *= 0.95
    return f"WITH {', '.join(parts)} SELECT i, round(w, 6) AS w FROM w{rounds}"


@query("sgd_svm", _svm_sql(10))
def sgd_svm(spark, d):
    v = _vectors(spark, d).withColumn("y", F.when(F.col("label") < 5, -1.0).otherwise(1.0))
    weights, losses = ml.sgd_svm(v, "vec_id", "e", "y", 64)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i int, w double").withColumn("w", F.round("w", 6))


@query("distributed_sum", "SELECT sum(l_orderkey)::BIGINT AS total, count(*) AS n FROM lineitem")
def distributed_sum(spark, d):
    return table(spark, d, "lineitem").agg(F.sum("l_orderkey").alias("total"), F.count(F.lit(1)).alias("n"))
