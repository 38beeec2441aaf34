"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = 8 << 20  # bytes of text that are worked on at once, unless one text is longer


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema, timestamp_utc=True, prefers_large_types=False)


def map_arrow(df: DataFrame, f, schema: T.StructType) -> DataFrame:
    """mapInArrow with `f: (RecordBatch) -> Iterable[RecordBatch]` on each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Dictionary codes of a column; null has a code of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One plain (non-view, 32-bit offset) string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == pa.string() else column.cast(pa.string())


def row_chunks(n: int, size: int) -> Iterable[tuple[int, int]]:
    return ((i, min(n, i + size)) for i in range(0, n, size))


def fresh(name: str, taken: set[str]) -> str:
    """`name`, or with a suffix if a column of that name (letter case aside) exists; the choice is added to `taken`."""
    new, k = name, 1
    while new.lower() in taken:
        k += 1
        new = f"{name}_{k}"
    taken.add(new.lower())
    return new


def byte_pieces(texts: pa.Array, size: int = CHUNK) -> list[tuple[int, int]]:
    """Row ranges of about `size` bytes of text each, so that memory doesn't grow with the length of texts in a batch."""
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    part = (offsets[:-1] - offsets[0]) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return list(zip(cuts[:-1], cuts[1:]))
