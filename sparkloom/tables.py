"""Tables of a data folder, one Parquet file or directory each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import share_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "messages globals correct results trace_lines peers trigger_list global_keys eval_items"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_path(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Temporary views for the tables named (all that exist are cheap: Parquet footers only)."""
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
