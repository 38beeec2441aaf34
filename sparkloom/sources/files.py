"""Sources and sinks: values, files, ordered merges of files, typed loaders, gathering results."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkloom.operators.arrowtools import arrow_schema
from sparkloom.session import checkpoint_dir

SEPARATORS = {"csv": ",", "psv": "|", "tsv": "\t"}


def value(spark: SparkSession, row: tuple, schema: str) -> DataFrame:
    """A source that emits one constant."""
    return spark.createDataFrame([row], schema)


def read(spark: SparkSession, paths: str | list[str], fmt: str, schema: str | None = None, **options) -> DataFrame:
    """Files of a format: csv, psv, tsv (schema needed), json, parquet, orc, text (column value), raw (path and bytes)."""
    if fmt in SEPARATORS:
        if schema is None:
            raise ValueError("delimited files need a schema; it isn't guessed from the data")
        return spark.read.csv(paths, schema=schema, sep=SEPARATORS[fmt], **options)
    if fmt == "raw":
        return spark.read.format("binaryFile").load(paths).select("path", "content")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(fmt).load(paths)


def file_sequence(spark: SparkSession, paths: list[str], fmt: str, schema: str | None = None, **options) -> DataFrame:
    """Files one after another: their rows with `file_no`, the place of the file in the list."""
    return reduce(DataFrame.unionByName, [read(spark, p, fmt, schema, **options).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)])


def file_mux(channels: list[DataFrame], order: str = "order") -> DataFrame:
    """K-way merge of channels by their order column: rows with `channel`, sorted. Equal orders go by channel."""
    tagged = [c.withColumn("channel", F.lit(i)) for i, c in enumerate(channels)]
    return reduce(DataFrame.unionByName, tagged).orderBy(order, "channel")


def file_mux_sequence(spark: SparkSession, channels: list[list[str]], fmt: str, schema: str, order: str = "order") -> DataFrame:
    """A merge in which each channel is a sequence of files."""
    return file_mux([file_sequence(spark, paths, fmt, schema).drop("file_no") for paths in channels], order)


def poly_file(relations: list[DataFrame], order: DataFrame, rebatch: int) -> DataFrame:
    """Rows of several relations in the order of an order table (seq, tag): the k-th entry of a tag takes the k-th row of that
    relation. -> seq, batch = seq div rebatch, tag and one struct column r0, r1, ... per relation.

    Relations have a column `pos`, their places from 0.
    """
    from sparkloom.operators.bag import with_position

    parts = []
    for tag, r in enumerate(relations):
        slots = with_position(order.where(F.col("tag") == tag), ["seq"], "pos")
        body = r.select("pos", F.struct(*[c for c in r.columns if c != "pos"]).alias(f"r{tag}"))
        parts.append(slots.join(body, "pos").drop("pos"))
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return joined.withColumn("batch", F.expr(f"seq div {rebatch}"))


def relation_batches(relations: dict[str, DataFrame], order: DataFrame, rebatch: int) -> DataFrame:
    """`poly_file` for named relations and an order table (seq, relation)."""
    places = F.create_map(*[x for i, name in enumerate(relations) for x in (F.lit(name), F.lit(i))])
    tagged = order.select("seq", F.try_element_at(places, "relation").alias("tag")).where("tag IS NOT NULL")
    return poly_file(list(relations.values()), tagged, rebatch).withColumnsRenamed({f"r{i}": name for i, name in enumerate(relations)})


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


# Columns of the public web-log benchmark's tables.
RANKINGS = "pageURL string, pageRank int, avgDuration int"
USERVISITS = "sourceIP string, destURL string, visitDate date, adRevenue double, userAgent string, countryCode string, languageCode string, searchWord string, duration int"


def load_rankings(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Pages; only the columns named are parsed."""
    df = read(spark, path, "csv", RANKINGS)
    return df.select(*columns) if columns else df


def load_uservisits(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Visits; only the columns named are parsed."""
    df = read(spark, path, "csv", USERVISITS)
    return df.select(*columns) if columns else df


def parse_vector(line: Column, separator: str = ",") -> Column:
    return F.transform(F.split(line, separator), lambda x: x.cast("double"))


def parse_labelled_vector(line: Column, dims: int, separator: str = ",") -> tuple[Column, Column]:
    """(features, label): the first `dims` numbers and the next."""
    v = parse_vector(line, separator)
    return F.slice(v, 1, dims), F.get(v, F.lit(dims))


def load_graph(lines: DataFrame, column: str = "value") -> DataFrame:
    """Edges (src, dst) of lines src,dst,dst,...; a line with a source only has a vertex without edges and gives dst null."""
    parts = F.split(F.trim(F.col(column)), ",")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    return lines.where(F.length(F.trim(F.col(column))) > 0).select(parts[0].cast("long").alias("src"), F.explode_outer(rest).alias("dst")).select("src", F.col("dst").cast("long").alias("dst"))


def gather(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One file of all rows, for results that are small by nature."""
    df.coalesce(1).write.mode("overwrite").format("csv" if fmt in SEPARATORS else fmt).options(**({"sep": SEPARATORS[fmt]} if fmt in SEPARATORS else {})).save(path)


def write(df: DataFrame, path: str, fmt: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if fmt in SEPARATORS:
        writer.option("sep", SEPARATORS[fmt]).csv(path)
    else:
        writer.format(fmt).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table hash-partitioned and sorted by key, so that joins and aggregates on the key need no shuffle; under `path`, or else in the warehouse."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> None:
    """A collection as it is, with its types, for `load`."""
    write(df, path, "parquet")


def load(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, "parquet")


def repack(df: DataFrame) -> DataFrame:
    """(buffer): rows in flat self-contained buffers, an Arrow stream for each batch, that can be sent or stored as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["buffer"])

    return df.mapInArrow(run, "buffer binary")


def unpack(buffers: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of buffers made by `repack` of rows of that schema."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer in batch.column(0).to_pylist():
                for part in pa.ipc.open_stream(buffer):
                    yield from pa.Table.from_batches([part]).rename_columns(target.names).cast(target).to_batches()

    return buffers.select("buffer").mapInArrow(run, schema)


class Reader:
    """A handle on rows for imperative code: elements or blocks one after another, a partition of them at a time at the driver. For control files and tests; data go through DataFrames."""

    def __init__(self, df: DataFrame):
        self._rows = df.toLocalIterator(prefetchPartitions=False)
        self._next: list = []

    def has_read(self) -> bool:
        if not self._next:
            self._next = list(islice(self._rows, 1))
        return bool(self._next)

    def do_read(self):
        """The next element; StopIteration at the end."""
        if not self.has_read():
            raise StopIteration
        return self._next.pop()

    def do_block_read(self, n: int) -> list:
        """At most n elements; none at the end."""
        return [self.do_read() for _ in range(n) if self.has_read()]

    def close(self) -> None:
        self._rows, self._next = iter(()), []


class Writer:
    """A handle that appends elements to a file in blocks; what is not flushed yet is written by `close`."""

    def __init__(self, spark: SparkSession, path: str, fmt: str, schema: str, block: int = 10_000):
        self.spark, self.path, self.fmt, self.schema, self.block = spark, path, fmt, schema, block
        self._held: list[tuple] = []
        self._open = True

    def has_write(self) -> bool:
        return self._open

    def do_write(self, *row) -> None:
        if not self._open:
            raise ValueError("the handle is closed")
        self._held.append(row)
        if len(self._held) >= self.block:
            self.flush()

    def flush(self) -> None:
        if self._held:
            df = self.spark.createDataFrame(self._held, self.schema).coalesce(1)
            writer = df.write.mode("append").format("csv" if self.fmt in SEPARATORS else self.fmt)
            (writer.option("sep", SEPARATORS[self.fmt]) if self.fmt in SEPARATORS else writer).save(self.path)
            self._held = []

    def close(self) -> None:
        self.flush()
        self._open = False


def open_file(spark: SparkSession, path: str, fmt: str, schema: str | None = None, mode: str = "r") -> Reader | Writer:
    """A handle to read (r) or write (w) a file of a format of `read`."""
    if mode not in ("r", "w"):
        raise ValueError("mode is r or w")
    return Reader(read(spark, path, fmt, schema)) if mode == "r" else Writer(spark, path, fmt, schema)


def open_value(spark: SparkSession, row: tuple, schema: str) -> Reader:
    """A handle on one constant."""
    return Reader(value(spark, row, schema))


# Types of declarations and their place here: int, real, bool, string, byte, date as yyyymmdd.
TYPES = {"int": T.IntegerType(), "real": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "byte": T.ByteType(), "date": T.IntegerType(), "address": T.StringType()}
ZEROS = {"int": 0, "real": 0.0, "bool": False, "string": "", "byte": 0, "date": 0, "address": "0.0.0.0:0"}


def date_int(d: datetime.date) -> int:
    return d.year * 10000 + d.month * 100 + d.day
