"""Structured Streaming: triggers, keyed state, timers, symmetric joins and signed update streams.

A trigger is a function of a micro-batch or of keyed state; a stream that ends is run with availableNow, whose completion is the end-of-stream mark.
"""

from __future__ import annotations

import socketserver
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkloom.operators.keyed import last_write
from sparkloom.session import checkpoint_dir, share_path


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its files."""
    share_path(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines (column value) of a TCP source."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def run_to_socket(stream: DataFrame, host: str, port: int) -> None:
    """Sends the lines (column value) of a stream that ends to a TCP server; each partition of a batch has a connection of its own.

    A partition that runs again after a failure sends its lines again.
    """

    def send(rows: Iterator) -> None:
        import socket

        first = next(rows, None)
        if first is None:
            return
        with socket.create_connection((host, port)) as s, s.makefile("w", encoding="utf-8", newline="\n") as out:
            out.write(first.value + "\n")
            out.writelines(r.value + "\n" for r in rows)

    at = f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    lines = stream.select(F.col("value").cast("string").alias("value")).where("value IS NOT NULL")
    query = lines.writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.foreachPartition(send)).start()
    query.awaitTermination()


class LineServer:
    """A TCP server that keeps the lines sent to it until `lines`; for tests and small results."""

    def __init__(self, host: str = "127.0.0.1"):
        kept, lock = [], threading.Lock()

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                got = [x.decode("utf-8").removesuffix("\n") for x in self.rfile]
                with lock:
                    kept.extend(got)

        class Server(socketserver.ThreadingTCPServer):
            block_on_close, daemon_threads = True, False

        self._kept, self._server = kept, Server((host, 0), Handler)
        self.host, self.port = self._server.server_address
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)

    def __enter__(self) -> LineServer:
        self._thread.start()
        return self

    def lines(self) -> list[str]:
        """All lines of connections that are closed; waits for those that are open. No more come after."""
        self._server.shutdown()
        self._server.server_close()
        return list(self._kept)

    def __exit__(self, *_) -> None:
        self._server.shutdown()
        self._server.server_close()


def stop_when(query, done: Callable[[], bool], poll_seconds: float = 0.5, drain: bool = True) -> None:
    """Ends a running query once `done` says so: after what has arrived (drain), or at once."""
    while query.isActive and not done():
        time.sleep(poll_seconds)
    if query.isActive:
        if drain:
            query.processAllAvailable()
        query.stop()


def to_console(stream: DataFrame, mode: str = "append"):
    """Standard output as a sink; returns the running query."""
    return stream.writeStream.outputMode(mode).format("console").start()


def run_to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """The result of a stream that ends: all rows (append), the last state (complete), or the last row per key (update).

    Batches are written to the shared folder by number, so a batch that runs again after a failure replaces its own rows. on_batch is
    called with each batch as well.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs keys")
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        if on_batch:
            on_batch(batch, number)
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{at}/out")
    except Exception as e:  # no batch ran
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("b")).first()["b"]
        return rows.where(F.col("batch") == F.lit(last)).drop("batch")
    return (last_write(rows, keys, F.col("batch")) if mode == "update" else rows).drop("batch")


def running_aggregate(stream: DataFrame, keys: list[str], /, **aggregates: Column) -> DataFrame:
    """insert_with in a loop: state per key, emitted when it changes (update mode)."""
    return stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def symmetric_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Both sides build and probe as they arrive. Watermarks and a time bound in `on` let old rows go."""
    return left.join(right, on, how)


def deduplicate(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; with a time column, state older than the watermark goes."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def signed_totals(updates: DataFrame, keys: list[str], sign: str, /, **values: str) -> DataFrame:
    """Views over streams of inserts (+1) and deletes (-1): count and totals per key, maintained by addition."""
    return updates.groupBy(*keys).agg(F.sum(sign).alias("count"), *[F.sum(F.col(c) * F.col(sign)).alias(n) for n, c in values.items()])


def corrected_snapshots(versions: DataFrame, keys: list[str], vid: str, late: DataFrame, amount: str) -> DataFrame:
    """Late data at version v correct all strictly newer versions: each version row gets the sum of late amounts older than it."""
    from sparkloom.operators.joins import asof_join

    sums = late.groupBy(*keys, F.col(vid).alias("_late")).agg(F.sum(amount).alias("_a"))
    names = ", ".join(f"`{k}`" for k in keys)
    prefix = sums.withColumn("_sum", F.expr(f"sum(_a) OVER (PARTITION BY {names} ORDER BY _late)")).drop("_a")
    return asof_join(versions, prefix, keys, vid, "_late", strict=True).withColumn("correction", F.coalesce("_sum", F.lit(0))).drop("_late", "_sum")


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def on_count(stream: DataFrame, key: str, n: int, reset: bool = False) -> DataFrame:
    """A counting barrier per key: (key, fired), a row when the n-th event of a key arrives; with reset, for each n events."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    schema = T.StructType([stream.schema[key], T.StructField("fired", T.LongType())])

    class Counter(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = self.seen.get()[0] if self.seen.exists() else 0
            now = before + sum(len(batch) for batch in rows)
            self.seen.update((now,))
            fired = range(before // n + 1, now // n + 1) if reset else range(1, 1 + (before < n <= now))
            yield pd.DataFrame({schema.names[0]: [key[0]] * len(fired), "fired": list(fired)})

        def close(self) -> None:
            pass

    _rocks(stream.sparkSession)
    return stream.select(key).groupBy(key).transformWithStateInPandas(Counter(), schema, "append", "none")


def key_value_store(requests: DataFrame, key: str, order: str, put: str) -> DataFrame:
    """A store with a value per key: (key, order, value) for each request whose `put` is null, value being what the newest put before it left, or null.

    Other requests put their value. The state is the newest value of a key. Requests of a key are taken in their order within a micro-batch, and micro-batches
    as they come.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    schema = T.StructType([requests.schema[key], requests.schema[order], T.StructField("value", requests.schema[put].dataType)])
    names = schema.names

    class Store(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getValueState("held", T.StructType([T.StructField("value", schema["value"].dataType)]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = self.held.get()[0] if self.held.exists() else None
            asked = pd.concat(list(rows)).sort_values(names[1], kind="stable")
            at, values = [], []
            for place, new in zip(asked[names[1]], asked[put]):
                if pd.isna(new):
                    at.append(place)
                    values.append(held)
                else:
                    held = new
            if held is not None:
                self.held.update((held,))
            yield pd.DataFrame({names[0]: [key[0]] * len(at), names[1]: at, "value": values})

        def close(self) -> None:
            pass

    _rocks(requests.sparkSession)
    return requests.select(key, order, put).groupBy(key).transformWithStateInPandas(Store(), schema, "append", "none")


def delayed(stream: DataFrame, key: str, at: str, delay_ms: int, override: bool = True) -> DataFrame:
    """Timers per key: (key, fires_at, n), one row when a timer fires delay_ms after the event that set it, with the events seen so far.

    With override a new event replaces the pending timer of its key, else every event sets a timer of its own. Times are event times, by watermark; what is pending
    when the stream ends fires when later events move the watermark, so an ending stream is closed by a last event far ahead.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kind = stream.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("fires_at", T.LongType()), T.StructField("n", T.LongType())])

    class Timers(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n = self.seen.get()[0] if self.seen.exists() else 0
            last = None
            for batch in rows:
                if not len(batch):
                    continue
                n += len(batch)
                for t in batch["event_millis"]:
                    if override:
                        last = max(last or 0, int(t) + delay_ms)
                    else:
                        self.handle.registerTimer(int(t) + delay_ms)
            if last is not None:
                for old in list(self.handle.listTimers()):
                    old = old[0] if isinstance(old, tuple) else old
                    last = max(last, old)
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(last)
            self.seen.update((n,))
            yield pd.DataFrame({c: pd.Series(dtype="object") for c in schema.names})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            n = self.seen.get()[0]
            yield pd.DataFrame({schema.names[0]: [key[0]], "fires_at": [expiredTimerInfo.getExpiryTimeInMs()], "n": [n]})

        def close(self) -> None:
            pass

    _rocks(stream.sparkSession)
    rows = stream.withColumn("event_millis", F.unix_millis(F.col(at))).withWatermark(at, "0 seconds")
    return rows.groupBy(key).transformWithStateInPandas(Timers(), schema, "append", "eventTime")
