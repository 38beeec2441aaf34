"""Loading delimited lines with the rows that cannot be loaded set apart, each with its reason."""

from __future__ import annotations

import json
import re
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.arrowtools import arrow_schema, byte_pieces, fresh, map_arrow, row_chunks, text_array
from sparkloom.operators.jsonvalues import is_json

BLOCK = 1024  # records of the first blocks
_MAX_INT = 2**31 - 1
_DIGITS = re.compile("[0-9]+")


class Layout:
    """Fields of a line: names in order, the delimiter and the quote, and which fields are JSON or non-negative 32-bit integers."""

    def __init__(self, fields: list[str], json_fields: list[str], int_fields: list[str], delimiter: str = "|", quote: str = "'", nulls: tuple[str, ...] = ("", "null")):
        if len(delimiter) != 1 or len(quote) != 1 or delimiter == quote:
            raise ValueError("delimiter and quote are two different characters")
        self.fields, self.json_fields, self.int_fields, self.nulls = fields, json_fields, int_fields, nulls
        self.delimiter, self.quote = delimiter, quote
        d, q = re.escape(delimiter), re.escape(quote)
        one = f"(?:{q}(?:[^{q}]|{q}{q})*{q}|(?:[^{d}{q}][^{d}]*)?)"
        self.structure = f"(?s)^{one}(?:{d}{one}){{{len(fields) - 1}}}$"
        self.split = "(?s)^" + d.join(f"(?P<f{i}>{one})" for i in range(len(fields))) + "$"


def split_line(line: str, layout: Layout) -> tuple[str | None, list[str], list[bool]]:
    """(reason, fields, which were quoted) of one line, read character by character where quotes stand."""
    d, q = layout.delimiter, layout.quote
    line = line[:-1] if line.endswith("\r") else line
    fields, quoted, i, n = [], [], 0, len(line)
    while True:
        if line.startswith(q, i):
            parts, j = [], i + 1
            while True:
                k = line.find(q, j)
                if k < 0:
                    return "unclosed_quote", fields, quoted
                parts.append(line[j:k])
                if not line.startswith(q, k + 1):
                    break
                parts.append(q)
                j = k + 2
            fields.append("".join(parts))
            quoted.append(True)
            i = k + 1
            if i < n and line[i] != d:
                return "text_after_quote", fields, quoted
        else:
            k = line.find(d, i)
            k = n if k < 0 else k
            fields.append(line[i:k])
            quoted.append(False)
            i = k
        if i >= n:
            break
        i += 1
    return (None if len(fields) == len(layout.fields) else "field_count"), fields, quoted


def diagnose(line: str | None, layout: Layout) -> tuple[str | None, list[str | None]]:
    """(reason, fields) of one line by the strict rules; reason is None for a sound line. The first failing rule counts:
    null_line, unclosed_quote, text_after_quote, field_count, then by field in order <field>_empty, <field>_not_json,
    <field>_not_digits, <field>_range."""
    none: list[str | None] = [None] * len(layout.fields)
    if line is None:
        return "null_line", none
    reason, values, quoted = split_line(line, layout)
    if reason:
        return reason, none
    for name, v in zip(layout.fields, values):
        if name in layout.json_fields:
            if not v.strip(" \t\r\n"):
                return f"{name}_empty", none
            if not is_json(v):
                return f"{name}_not_json", none
        if name in layout.int_fields:
            v = v.strip()
            if not v:
                return f"{name}_empty", none
            if not _DIGITS.fullmatch(v):
                return f"{name}_not_digits", none
            v = v.lstrip("0") or "0"
            if len(v) > 10 or int(v) > _MAX_INT:
                return f"{name}_range", none
    checked = {*layout.json_fields, *layout.int_fields}
    return None, [None if n not in checked and not was and v in layout.nulls else v for n, v, was in zip(layout.fields, values, quoted)]


def _all_json(values: list[str]) -> bool:
    """Whether each text is exactly one JSON value, by one parse of them all. Unguessable separators stand between them:
    no text can hold one, so texts that are no single value cannot make up for one another."""
    mark = secrets.token_hex(16)
    try:
        got = json.loads("[" + f',"{mark}",'.join(values) + "]", parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return len(got) == 2 * len(values) - 1 and all(x == mark for x in got[1::2])


def _refuse(name: str):
    raise ValueError(name)


def _columns(lines: pa.Array, layout: Layout) -> tuple[list[pa.Array], np.ndarray]:
    """Fields of lines that keep to the layout, and which lines have sound integers and no empty JSON."""
    parts = pc.extract_regex(lines, layout.split)
    ok = np.ones(len(lines), dtype=bool)
    out = []
    for i, name in enumerate(layout.fields):
        f = parts.field(i)
        quoted = pc.starts_with(f, layout.quote)
        if pc.any(quoted).as_py():
            inner = pc.replace_substring(pc.utf8_slice_codeunits(f, 1, -1), layout.quote * 2, layout.quote)
            plain, f = f, pc.if_else(quoted, inner, f)
        else:
            plain = f
        if name in layout.int_fields:
            f = pc.utf8_trim_whitespace(f)
            digits = pc.match_substring_regex(f, "^[0-9]+$")
            short = pc.replace_substring_regex(f, "^0+([0-9])", r"\1")
            sized = pc.and_(digits, pc.less_equal(pc.utf8_length(short), 10))
            number = pc.cast(pc.if_else(sized, short, "0"), pa.int64())
            ok &= pc.and_(sized, pc.less_equal(number, _MAX_INT)).to_numpy(zero_copy_only=False)
        elif name not in layout.json_fields and layout.nulls:
            bare = pc.and_(pc.is_in(plain, pa.array(list(layout.nulls))), pc.invert(quoted))
            f = pc.if_else(bare, pa.scalar(None, pa.string()), f)
        out.append(f)
    return out, ok


def parse_block(lines: pa.Array, layout: Layout, block: list[int]) -> tuple[list[pa.Array], list[str | None]]:
    """Fields of the lines (null where the line is rejected) and the reason per line.

    Whole columns are split and checked at once; JSON is checked by parsing a block of records in one go. A block that
    fails is halved again and again until the failing records stand alone. Those, and lines that the column checks put
    aside, are diagnosed strictly, which may also find them sound. `block` holds the block size, fitted to the share of
    failing records as they come.
    """
    n = len(lines)
    given, lines = lines, pc.replace_substring_regex(lines, "\\r\\z", "")
    fits = pc.fill_null(pc.match_substring_regex(lines, layout.structure), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    columns, ok = _columns(lines.take(pa.array(at)), layout)
    at, columns = at[ok], [c.filter(pa.array(ok)) for c in columns]
    good = np.zeros(n, dtype=bool)
    texts = [c.to_pylist() for f, c in zip(layout.fields, columns) if f in layout.json_fields]
    todo = [(i, j) for i, j in row_chunks(len(at), block[0])]
    failed = 0
    sound = np.ones(len(at), dtype=bool)
    while todo:
        i, j = todo.pop()
        if all(_all_json(t[i:j]) for t in texts):
            continue
        if j - i == 1:
            sound[i] = False
            failed += 1
        else:
            todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
    if len(at):
        block[0] = int(min(BLOCK, max(8, len(at) / (2 * failed + 1))))
    good[at[sound]] = True
    reasons: list[str | None] = [None] * n
    rescued: dict[int, list[str | None]] = {}
    original = given.take(pa.array(np.flatnonzero(~good))).to_pylist()
    for k, line in zip(np.flatnonzero(~good), original):
        reasons[k], values = diagnose(line, layout)
        if reasons[k] is None:
            rescued[int(k)] = values
    place = np.full(n, -1, dtype=np.int64)
    place[at[sound]] = np.flatnonzero(sound)
    extra = {k: len(at) + i for i, k in enumerate(rescued)}
    for k, i in extra.items():
        place[k] = i
    index = pa.array(place, mask=place < 0)
    full = [pa.concat_arrays([text_array(c), pa.array([rescued[k][f] for k in rescued], pa.string())]) for f, c in enumerate(columns)]
    return [c.take(index) for c in full], reasons


def load_lines(df: DataFrame, line: str, layout: Layout, keep: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Each row of `df` once: the columns `keep`, the fields of its line and `reason`, which is null for a sound line.

    Method: record blocks on a columnar path, bisection of failing blocks, strict diagnosis of the rest; see
    `parse_block`. No shuffle. Rejected rows have null fields. types casts fields (an unfit text becomes null). A null line is rejected as null_line,
    an empty one as field_count. One carriage return at the end of a line doesn't count. Repeated lines stay. Columns not in
    `keep` are left out; a field whose name is that of a kept column gets the suffix _2. An empty table gives an empty one.
    """
    taken = {c.lower() for c in keep}
    names = [fresh(f, taken) for f in [*layout.fields, "reason"]]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(f, T.StringType()) for f in names])
    target = arrow_schema(schema)
    block = [BLOCK]

    def parse(batch: pa.RecordBatch):
        lines = text_array(batch.column(len(keep)))
        for i, j in byte_pieces(lines):
            fields, reasons = parse_block(lines.slice(i, j - i), layout, block)
            arrays = [batch.column(c).slice(i, j - i) for c in range(len(keep))] + fields + [pa.array(reasons, pa.string())]
            yield from pa.table(arrays, names=target.names).cast(target).to_batches()

    loaded = map_arrow(df.select(*keep, F.col(line).cast("string").alias("_line")), parse, schema)
    of = dict(zip(layout.fields, names))
    return loaded.withColumns({of[f]: F.expr(f"try_cast(trim(`{of[f]}`) AS {t})") for f, t in (types or {}).items()})


def sound(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col("reason").isNull()).drop("reason")


def rejected(loaded: DataFrame, keep: list[str]) -> DataFrame:
    return loaded.where(F.col("reason").isNotNull()).select(*keep, "reason")
