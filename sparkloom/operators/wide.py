"""Attribute-value rows into wide tables: one row per entity, one typed column per declared attribute."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.arrowtools import arrow_schema, codes, fresh
from sparkloom.operators.jsonvalues import TYPES, conform

_SPARK = {"int": T.IntegerType(), "real": T.DoubleType(), "bool": T.BooleanType()}
_CACHE = 200_000  # parsed values that a worker keeps


def attribute_cells(df: DataFrame, entity: list[str], key: str, value: str, declared: list[tuple[str, str]]) -> DataFrame:
    """A row per batch and entity: attributes (places in `declared`), the least conforming value of each, and whether its cell cannot be
    filled, as values of the batch do not conform or differ.

    The combining here, before any shuffle, leaves at most one row per batch and entity, so an entity that
    holds most of the table costs no task more than its share. An attribute of -1 stands for undeclared or null keys and only says that
    the entity exists.
    """
    place = {k.strip().lower(): i for i, (k, _) in reversed(list(enumerate(declared)))}
    kinds = [t for _, t in declared]
    arrays = [("_attr", T.IntegerType()), ("_value", T.StringType()), ("_bad", T.BooleanType())]
    schema = T.StructType([T.StructField(f"_e{i}", df.schema[c].dataType) for i, c in enumerate(entity)] + [T.StructField(n, T.ArrayType(t)) for n, t in arrays])
    target = arrow_schema(schema)
    ne = len(entity)
    cell_schema = _cell_schema(target, ne)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], tuple[str | None, bool]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(ne).cast(pa.string()).dictionary_encode()
            attr_of = np.array([place.get(k.strip().lower(), -1) for k in keys.dictionary.to_pylist()] + [-1], dtype=np.int32)
            attr = attr_of[keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)]
            found: list[str | None] = [None] * batch.num_rows
            bad = np.zeros(batch.num_rows, dtype=bool)
            texts = batch.column(ne + 1).to_pylist()
            for i in np.flatnonzero(attr >= 0).tolist():
                text = texts[i]
                if text is None:
                    continue
                a = int(attr[i])
                if (r := seen.get((a, text))) is None:
                    if len(seen) >= _CACHE:
                        seen.clear()
                    r = seen[a, text] = conform(text, kinds[a])
                found[i], bad[i] = r
            values = pa.array(found, pa.string())
            cells = _sorted(_combine([batch.column(i) for i in range(ne)], pa.array(attr), values, values, pa.array(bad), cell_schema), ne)
            row, first = _rows_of(cells, ne)
            offsets = pa.array(np.append(first, cells.num_rows), pa.int32())
            lo, clash = cells.column("_lo").combine_chunks(), pc.fill_null(pc.not_equal(cells.column("_lo"), cells.column("_hi")), False)
            lists = [cells.column("_attr").combine_chunks(), lo, pc.or_(clash, cells.column("_bad")).combine_chunks()]
            packed = [cells.column(i).combine_chunks().take(pa.array(first)) for i in range(ne)] + [pa.ListArray.from_arrays(offsets, x) for x in lists]
            yield from pa.table(packed, names=target.names).cast(target).to_batches()

    chosen = df.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(entity)], F.col(key).alias("_key"), F.col(value).cast("string").alias("_value"))
    return chosen.mapInArrow(run, schema)


def _cell_schema(packed: pa.Schema, ne: int) -> pa.Schema:
    return pa.schema([*[packed.field(i) for i in range(ne)], pa.field("_attr", pa.int32()), pa.field("_lo", pa.string()), pa.field("_hi", pa.string()), pa.field("_bad", pa.bool_())])


def _unpacked(batch: pa.RecordBatch, ne: int) -> pa.RecordBatch:
    """A row per cell."""
    parent = pc.list_parent_indices(batch.column(ne))
    attr, value, bad = (pc.list_flatten(batch.column(ne + i)) for i in range(3))
    return pa.RecordBatch.from_arrays([*[batch.column(i).take(parent) for i in range(ne)], attr, value, value, bad], schema=_cell_schema(batch.schema, ne))


def _combine(entity: list, attr, lo, hi, bad, target: pa.Schema) -> pa.Table:
    """One row per entity and attribute."""
    names = target.names[: len(entity)]
    t = pa.table([*entity, attr, lo, hi, bad], names=[*names, "_attr", "_lo", "_hi", "_bad"])
    t = t.group_by([*names, "_attr"]).aggregate([("_lo", "min"), ("_hi", "max"), ("_bad", "max")])
    return t.select([*names, "_attr", "_lo_min", "_hi_max", "_bad_max"]).rename_columns(target.names).cast(target)


def eav_to_wide(df: DataFrame, entity: list[str], key: str, value: str, declared: list[tuple[str, str]], unfilled: str = "unfilled") -> DataFrame:
    """Entity, attribute, value rows -> one row per entity with a typed column per declared attribute.

    Method: entities go to hash buckets (one shuffle, after per-batch combining); in each bucket, sorted by entity,
    entities and attributes get dictionary codes, and values are scattered into one numpy array per type by row and
    column code; Arrow tables come out.

    declared: (name, type) with a type of int (32 bits), real, bool, string, address, collection. Keys are compared without
    surrounding white space and letter case; the first of two declarations of one key holds. Values are JSON, see
    `conform`. A cell is null if no value came, a value does not conform or two conforming values differ; the names of
    cells of the latter two kinds stand in the array column `unfilled`. Null entity fields are values like others. An
    entity of undeclared keys only has a row of nulls. Other columns of `df` don't matter; an attribute whose name, letter
    case aside, is that of an entity column or another attribute gets the suffix _2. An empty table gives an empty table.
    """
    if unknown := {t for _, t in declared} - set(TYPES):
        raise ValueError(f"unknown types {unknown}")
    taken = {c.lower() for c in [*entity, unfilled]}
    columns = [fresh(k, taken) for k, _ in declared]
    kinds = [t for _, t in declared]
    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in entity]
        + [T.StructField(c, _SPARK.get(t, T.StringType())) for c, t in zip(columns, kinds)]
        + [T.StructField(unfilled, T.ArrayType(T.StringType()))]
    )
    target = arrow_schema(schema)
    ne = len(entity)
    names = pa.array([k for k, _ in declared], pa.string())

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole entities, combined and sorted."""
        row, first = _rows_of(t, ne)
        rows = len(first)
        attr = t.column("_attr").to_numpy()
        lo, hi = t.column("_lo").combine_chunks(), t.column("_hi").combine_chunks()
        clash = pc.fill_null(pc.not_equal(lo, hi), False).to_numpy(zero_copy_only=False)
        out = (attr >= 0) & (clash | t.column("_bad").to_numpy())
        fill = (attr >= 0) & ~out & lo.is_valid().to_numpy(zero_copy_only=False)
        arrays = [t.column(i).combine_chunks().take(pa.array(first)) for i in range(ne)]
        for kind in dict.fromkeys(kinds):
            mine = [j for j, k in enumerate(kinds) if k == kind]
            slot = np.full(len(kinds), -1)
            slot[mine] = np.arange(len(mine))
            at = np.flatnonzero(fill & np.isin(attr, mine))
            r, c = row[at], slot[attr[at]]
            text = lo.take(pa.array(at))
            if kind in ("int", "real", "bool"):
                grid = np.zeros((rows, len(mine)), dtype={"int": np.int32, "real": np.float64, "bool": bool}[kind])
                empty = np.ones(grid.shape, dtype=bool)
                grid[r, c] = {"int": lambda: text.cast(pa.int32()).to_numpy(), "real": lambda: np.array(text.to_pylist(), dtype=np.float64), "bool": lambda: pc.equal(text, "true").to_numpy(zero_copy_only=False)}[kind]()
                empty[r, c] = False
                done = {j: pa.array(grid[:, s], mask=empty[:, s]) for s, j in enumerate(mine)}
            else:
                grid = np.full((rows, len(mine)), -1, dtype=np.int64)
                grid[r, c] = np.arange(len(at))
                done = {j: text.take(pa.array(grid[:, s], mask=grid[:, s] < 0)) for s, j in enumerate(mine)}
            for j, a in done.items():
                arrays.append((j, a))
        cells_ = [a for _, a in sorted((x for x in arrays if isinstance(x, tuple)), key=lambda x: x[0])]
        offsets = np.zeros(rows + 1, dtype=np.int32)
        offsets[1:] = np.cumsum(np.bincount(row[out], minlength=rows))
        lists = pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(attr[out])))
        yield from pa.table([*arrays[:ne], *cells_, lists], names=target.names).cast(target).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = lambda t: _sorted(_combine([t.column(i) for i in range(ne)], *[t.column(ne + i) for i in range(4)], t.schema), ne)
        for t in _whole_entities((_unpacked(b, ne) for b in batches), ne, merged):
            yield from flush(t)

    by = [f"_e{i}" for i in range(ne)]
    bucketed = attribute_cells(df, entity, key, value, declared).repartition(*by).sortWithinPartitions(*by)
    return bucketed.mapInArrow(run, schema)


def _whole_entities(batches: Iterator[pa.RecordBatch], ne: int, merge: Callable[[pa.Table], pa.Table] = lambda t: t) -> Iterator[pa.Table]:
    """Tables of whole entities from batches sorted by the first `ne` columns; `merge` shrinks what waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = merge(pa.concat_tables([held, t]) if held is not None else t)
        last = np.ones(t.num_rows, dtype=bool)  # rows of the last entity of the sorted input
        for i in range(ne):
            c = codes(pa.chunked_array([*t.column(i).chunks, batch.column(i).slice(batch.num_rows - 1)]))
            last &= c[:-1] == c[-1]
        if not last.all():
            yield t.filter(pa.array(~last))
        held = t.filter(pa.array(last))
    if held is not None and held.num_rows:
        yield held


def _rows_of(t: pa.Table, ne: int) -> tuple[np.ndarray, np.ndarray]:
    """(row number of each record, first record of each row) in a table sorted by entity."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for i in range(ne):
        c = codes(t.column(i))
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def scatter_numbers(df: DataFrame, entity: list[str], attribute: str, values: list[str], attributes: list[str], names: list[list[str]], fills: list[int | None]) -> DataFrame:
    """(entity, attribute, whole numbers) -> one row per entity with a column per attribute and value, by the method of `eav_to_wide`.

    names[i][j] is the column of values[j] for attributes[i]; fills[j] stands where an entity lacks the attribute. An entity and
    attribute stand at most once. Other attributes only say that the entity exists.
    """
    ne = len(entity)
    place = {a: i for i, a in enumerate(attributes)}
    schema = T.StructType([df.schema[c] for c in entity] + [T.StructField(n, T.LongType()) for group in names for n in group])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_entities(batches, ne):
            row, first = _rows_of(t, ne)
            coded = t.column(ne).combine_chunks().dictionary_encode()
            slot_of = np.array([place.get(a, -1) for a in coded.dictionary.to_pylist()] + [-1])
            slot = slot_of[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
            at = np.flatnonzero(slot >= 0)
            grids = []
            for j, fill in enumerate(fills):
                v = t.column(ne + 1 + j).combine_chunks()
                there = v.is_valid().to_numpy(zero_copy_only=False)
                grid = np.full((len(attributes), len(first)), fill or 0, dtype=np.int64)
                empty = np.full(grid.shape, fill is None)
                some = at[there[at]]
                grid[slot[some], row[some]] = v.fill_null(0).to_numpy(zero_copy_only=False)[some]
                empty[slot[some], row[some]] = False
                grids.append((grid, empty))
            arrays = [t.column(i).combine_chunks().take(pa.array(first)) for i in range(ne)]
            for i in range(len(attributes)):
                arrays += [pa.array(grid[i], mask=empty[i]) for grid, empty in grids]
            yield from pa.table(arrays, names=target.names).cast(target).to_batches()

    chosen = df.select(*entity, attribute, *[F.col(v).cast("long").alias(v) for v in values])
    return chosen.repartition(*entity).sortWithinPartitions(*entity).mapInArrow(run, schema)


def _sorted(t: pa.Table, ne: int) -> pa.Table:
    """Rows of an entity together, in the order of attributes; nulls as values, and floats by their bits as codes."""
    keys = {f"k{i}": codes(t.column(i)) for i in range(ne)} | {"a": t.column("_attr").to_numpy()}
    return t.take(pa.array(np.lexsort(list(reversed(list(keys.values()))))))


def pivot_rows(wide: DataFrame, entity: list[str], unfilled: str = "unfilled") -> DataFrame:
    """(entity, key) for each cell that could not be filled."""
    return wide.select(*entity, F.explode(unfilled).alias("key"))
