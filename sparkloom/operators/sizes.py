"""Whether a side of a join is small enough to go to all executors, by bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_BYTES = 256 << 20
_UNKNOWN = 1 << 60  # estimates from here on say nothing, as of rows made at the driver
_PACKED = 16  # Parquet may hold so many times less than what is read from it


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate. It is an upper bound of what the files hold packed, for plans that don't multiply rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _width(field: T.StructField) -> Column:
    """Bytes of a value, at least 8."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), F.lit(0)) + 8
    return F.lit(16 if isinstance(field.dataType, T.DecimalType) else 8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values; computes `df` once."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.agg(F.sum(measured_width(flat)).alias("b")).first()["b"] or 0


def measured_width(df: DataFrame) -> Column:
    """Bytes of a row."""
    return reduce(Column.__add__, [_width(f) for f in df.schema], F.lit(0)).cast("long")


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a side has at most `most` bytes. The plan's estimate decides where it is far from the bound; near it, or where there is none, the rows are measured."""
    planned = planned_bytes(df)
    if planned * _PACKED <= most and not _multiplies(df):
        return True
    return (planned <= most * _PACKED or planned >= _UNKNOWN) and measured_bytes(df) <= most


def _multiplies(df: DataFrame) -> bool:
    """Whether the plan may have more bytes than its estimate."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(word in plan for word in ("Generate", "Expand", "MapInArrow", "MapInPandas", "LogicalRDD", "Project [repeat"))
