"""Deeply nested records into linked flat tables, by structural indexing of whole batches."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.arrowtools import arrow_schema, byte_pieces, fresh, map_arrow, text_array

_OPEN, _CLOSE, _SEP = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[ord("{"), ord("[")]] = _OPEN
_CLASS[[ord("}"), ord("]")]] = _CLOSE
_CLASS[[ord(":"), ord(",")]] = _SEP
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 13]] = True


@dataclass(frozen=True)
class Kind:
    """A flat table: its name, the key whose presence makes an object a row of it, and further fields kept as raw JSON."""

    name: str
    marker: str
    fields: tuple[str, ...] = ()


class _Index:
    """Structure of a run of JSON records: tokens outside strings, nesting depth and the container of each token."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf = buf
        quote = np.flatnonzero(buf == 34)
        if len(quote):
            slash = np.flatnonzero(buf == 92)
            if len(slash):
                quote = quote[~_escaped(quote, slash)]
        self.slash = np.flatnonzero(buf == 92)
        kind = _CLASS[buf]
        at = np.flatnonzero(kind)
        rec = np.searchsorted(starts, at, "right") - 1
        first_quote = np.searchsorted(quote, starts)
        quotes_in = np.diff(np.append(first_quote, len(quote)))
        inside = (np.searchsorted(quote, at) - first_quote[rec]) & 1
        keep = inside == 0
        at, rec = at[keep], rec[keep]
        kind = kind[at]
        step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
        total = np.cumsum(step)
        first = np.searchsorted(at, starts)
        base = np.concatenate(([0], total))[first]
        depth = total - base[rec]  # after the token
        count = np.diff(np.append(first, len(at)))
        ok = quotes_in % 2 == 0
        low = np.zeros(len(starts), dtype=np.int64)
        np.minimum.at(low, rec, depth)
        end = np.zeros(len(starts), dtype=np.int64)
        filled = count > 0
        end[filled] = depth[first[filled] + count[filled] - 1]
        ok &= (low >= 0) & (end == 0)
        good = ok[rec]
        self.at, self.rec, self.kind, self.depth = at[good], rec[good], kind[good], depth[good]
        qrec = np.searchsorted(starts, quote, "right") - 1
        self.quote = quote[ok[qrec]]
        self.opens = np.flatnonzero(self.kind == _OPEN)
        order = np.argsort(self.depth[self.opens], kind="stable")
        self._by_depth = self.opens[order]
        self._m = len(self.at) + 1
        self._key = self.depth[self._by_depth] * self._m + self._by_depth

    def container(self, token: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Token of the container at `level` that encloses each token; -1 for none."""
        if not len(self._key):
            return np.full(len(token), -1)
        i = np.searchsorted(self._key, level * self._m + token) - 1
        found = np.where(i >= 0, self._by_depth[np.maximum(i, 0)], -1)
        ok = (level > 0) & (found >= 0)
        ok[ok] = (self.depth[found[ok]] == level[ok]) & (self.rec[found[ok]] == self.rec[token[ok]])
        return np.where(ok, found, -1)

    def closing(self, opens: np.ndarray) -> np.ndarray:
        """Token that closes each open token."""
        close = np.flatnonzero(self.kind == _CLOSE)
        level = self.depth[close] + 1
        order = np.argsort(level, kind="stable")
        key = level[order] * self._m + close[order]
        return close[order][np.searchsorted(key, self.depth[opens] * self._m + opens)]


def _escaped(at: np.ndarray, slash: np.ndarray) -> np.ndarray:
    """Whether an odd run of backslashes ends just before each place."""
    new = np.ones(len(slash), dtype=bool)
    new[1:] = np.diff(slash) != 1
    begin = slash[np.maximum.accumulate(np.where(new, np.arange(len(slash)), 0))]
    i = np.searchsorted(slash, at - 1)
    hit = np.zeros(len(at), dtype=bool)
    inside = i < len(slash)
    hit[inside] = slash[i[inside]] == at[inside] - 1
    odd = np.zeros(len(at), dtype=bool)
    odd[hit] = (at[hit] - begin[i[hit]]) & 1 == 1
    return odd


def _strip(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without blanks at either end."""
    lo, hi = lo.copy(), hi.copy()
    while len(on := np.flatnonzero((lo < hi) & _BLANK[buf[np.minimum(lo, len(buf) - 1)]])):
        lo[on] += 1
    while len(on := np.flatnonzero((lo < hi) & _BLANK[buf[np.maximum(hi - 1, 0)]])):
        hi[on] -= 1
    return lo, hi


def _take(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[str]:
    raw = buf.tobytes() if len(lo) else b""
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(lo.tolist(), hi.tolist())]


def _keys_named(ix: _Index, k_lo: np.ndarray, k_hi: np.ndarray, odd: np.ndarray, name: str) -> np.ndarray:
    """Which key spans spell `name`; keys with escapes are decoded one by one."""
    want = np.frombuffer(name.encode(), dtype=np.uint8)
    hit = k_hi - k_lo == len(want)
    on = np.flatnonzero(hit)
    for i, b in enumerate(want):
        on = on[ix.buf[k_lo[on] + i] == b]
    hit = np.zeros(len(k_lo), dtype=bool)
    hit[on] = True
    for i in np.flatnonzero(odd):
        try:
            hit[i] = json.loads('"' + ix.buf[k_lo[i] : k_hi[i]].tobytes().decode() + '"') == name
        except ValueError:
            pass
    return hit


def _level(texts: pa.Array, kinds: list[Kind]):
    """Rows of one level of records and the JSON texts written as strings inside them.

    -> nodes: per object with a marker (record, whether it is of each kind, parent node here or -1, nearest node here around it per kind
    or -1, marker and field texts); embedded: (texts, record of each, node here that encloses it or -1).
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    some = ends > starts  # an empty text would share its place with the next
    which = np.flatnonzero(some)
    ix = _Index(buf, starts[some], ends[some])

    colon = np.flatnonzero(ix.buf[ix.at] == 58)
    q = np.searchsorted(ix.quote, ix.at[colon])
    colon, q = colon[q >= 2], q[q >= 2]
    k_lo, k_hi = ix.quote[q - 2] + 1, ix.quote[q - 1]
    odd = np.searchsorted(ix.slash, k_hi) > np.searchsorted(ix.slash, k_lo)
    owner = ix.container(colon, ix.depth[colon])
    marks = {}
    for name in dict.fromkeys(n for k in kinds for n in (k.marker, *k.fields)):
        hit = _keys_named(ix, k_lo, k_hi, odd, name) & (owner >= 0)
        o, first = np.unique(owner[hit], return_index=True)
        marks[name] = o, colon[hit][first]

    # an object is of every kind whose marker it has
    of_kind = np.zeros((len(kinds), len(ix.at) + 1), dtype=bool)  # the last token stands for none
    for i, k in enumerate(kinds):
        of_kind[i, marks[k.marker][0]] = True
    is_node = of_kind.any(axis=0)
    nodes = np.flatnonzero(is_node)
    place = np.full(len(ix.at) + 1, -1)
    place[nodes] = np.arange(len(nodes))

    def climb(token: np.ndarray, level: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Nearest enclosing container that is `good` (by token; the last item stands for none)."""
        cur = ix.container(token, level)
        while len(on := np.flatnonzero((cur >= 0) & ~good[cur])):
            cur[on] = ix.container(cur[on], ix.depth[cur[on]] - 1)
        return cur

    around = ix.depth[nodes] - 1
    parent = place[climb(nodes, around, is_node)]
    near = [place[climb(nodes, around, of_kind[i])] for i in range(len(kinds))]

    def value_spans(colons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = colons + 1
        opened = ix.kind[nxt] == _OPEN
        lo, hi = _strip(ix.buf, ix.at[colons] + 1, ix.at[nxt] + opened)
        if opened.any():
            hi[opened] = ix.at[ix.closing(nxt[opened])] + 1
        return lo, hi

    fields = {}
    for name, (o, c) in marks.items():
        mine = np.flatnonzero(is_node[o])
        lo, hi = value_spans(c[mine])
        fields[name] = place[o[mine]], _take(ix.buf, lo, hi)

    # strings that hold JSON: those that begin with a bracket, keys aside
    opening, end = ix.quote[0::2], ix.quote[1::2]
    is_key = np.zeros(len(opening), dtype=bool)
    is_key[np.searchsorted(opening, k_lo - 1)] = True
    lo, hi = _strip(ix.buf, opening + 1, end)
    held = np.flatnonzero(~is_key & (hi - lo >= 2) & (_CLASS[ix.buf[np.minimum(lo, max(len(ix.buf) - 1, 0))]] == _OPEN)) if len(ix.buf) else np.zeros(0, int)
    inner, inner_rec, inner_parent = [], np.zeros(0, int), np.zeros(0, int)
    if len(held):
        rec = np.searchsorted(starts[some], opening[held], "right") - 1
        cur = np.full(len(held), -1)
        after = np.searchsorted(ix.at, opening[held])  # the next token; the string is in its container, or it closes that
        on = np.flatnonzero(after < len(ix.at))
        on = on[ix.rec[after[on]] == rec[on]]  # a string that is a whole record has none
        level = ix.depth[after[on]] + (ix.kind[after[on]] == _CLOSE)
        cur[on] = ix.container(after[on], level)
        while len(bad := np.flatnonzero((cur >= 0) & ~is_node[cur])):
            cur[bad] = ix.container(cur[bad], ix.depth[cur[bad]] - 1)
        pick = []
        for i, text in enumerate(_take(ix.buf, opening[held], end[held] + 1)):
            try:
                inner.append(json.loads(text, strict=False))
                pick.append(i)
            except ValueError:
                pass
        inner_rec, inner_parent = which[rec[pick]], place[cur[pick]]
    return which[ix.rec[nodes]], of_kind[:, nodes], parent, near, fields, (inner, inner_rec, inner_parent)


def _records(texts: pa.Array, kinds: list[Kind]):
    """All levels of a chunk, by node: record, whether it is of each kind, parent node, nearest node around it per kind, field texts."""
    rec, parent_base = np.arange(len(texts)), np.full(len(texts), -1)
    near_base = [np.full(len(texts), -1) for _ in kinds]
    out_rec, out_kind, out_parent, out_near = [], [], [], [[] for _ in kinds]
    out_fields: dict[str, list[tuple[np.ndarray, list[str]]]] = {}
    base = 0
    while len(texts):
        r, kind, parent, near, fields, (inner, inner_rec, inner_parent) = _level(texts, kinds)
        n = len(r)
        out_rec.append(rec[r])
        out_kind.append(kind)
        out_parent.append(np.where(parent >= 0, parent + base, parent_base[r]))
        own_near = [np.where(x >= 0, x + base, b[r]) for x, b in zip(near, near_base)]
        for o, x in zip(out_near, own_near):
            o.append(x)
        for name, (at, values) in fields.items():
            out_fields.setdefault(name, []).append((at + base, values))
        if not inner:
            break
        has = inner_parent >= 0
        at = np.maximum(inner_parent, 0)
        near_base = [
            np.where(has, np.where(kind[i, at], at + base, x[at]) if n else -1, b[inner_rec]) for i, (x, b) in enumerate(zip(own_near, near_base))
        ]
        parent_base = np.where(has, inner_parent + base, parent_base[inner_rec])
        texts, rec = pa.array(inner, pa.string()), rec[inner_rec]
        base += n
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, dtype=np.int64)
    of_kind = np.concatenate([np.zeros((len(kinds), 0), dtype=bool), *out_kind], axis=1)
    return cat(out_rec), of_kind, cat(out_parent), [cat(x) for x in out_near], out_fields


def flatten_records(df: DataFrame, keep: list[str], text: str, kinds: list[Kind]) -> DataFrame:
    """One row per object and kind it is of: `keep`, kind, node, parent, outer and outer_id (node and marker of the nearest object around it
    of the same kind), then <kind>_node and <kind>_id of the nearest object of each kind around it (its own for the kind of the
    row), and every field of that kind as JSON text.

    Method: in batches of records, bitmaps of quotes, brackets and delimiters are built, prefix sums give what is inside strings and the
    nesting depth, and spans of keys and values come from the positions; strings that hold JSON are unwrapped and indexed
    in turn, so objects count wherever and however they are written. An object is of every kind whose marker key it has, and its
    rows share a node; if a key repeats, the first counts. node numbers the objects of a record, parent is the node of the nearest one
    around or null.

    Null and empty texts, and records whose quotes or brackets don't balance, give no rows; so does text that only looks
    like a record inside a string without brackets. Repeated records give repeated rows. No shuffle, no cap on depth,
    size or count. Columns not in `keep` are left out; columns that clash get the suffix _2.
    """
    taken = {c.lower() for c in keep}
    name = lambda n: fresh(n, taken)
    fields = list(dict.fromkeys(n for k in kinds for n in k.fields))
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(name("kind"), T.StringType()), T.StructField(name("node"), T.IntegerType()), T.StructField(name("parent"), T.IntegerType()), T.StructField(name("outer"), T.IntegerType()), T.StructField(name("outer_id"), T.StringType())])
    for k in kinds:
        schema.add(name(f"{k.name}_node"), T.IntegerType()).add(name(f"{k.name}_id"), T.StringType())
    for f in fields:
        schema.add(name(f), T.StringType())
    target = arrow_schema(schema)
    names = pa.array([k.name for k in kinds])

    def parse(batch: pa.RecordBatch):
        texts = text_array(batch.column(len(keep)))
        for i, j in byte_pieces(texts):
            yield from emit(batch.slice(i, j - i), texts.slice(i, j - i))

    def emit(batch: pa.RecordBatch, texts: pa.Array):
        rec, of_kind, parent, near, values = _records(texts, kinds)
        if not len(rec):
            return
        n = len(rec)
        # nodes are numbered within their record, in the order found
        order = np.argsort(rec, kind="stable")
        first = np.searchsorted(rec[order], rec[order])
        number = np.empty(n, dtype=np.int64)
        number[order] = np.arange(n) - first
        numbered = lambda x: pa.array(np.where(x >= 0, number[x], -1), pa.int32(), mask=x < 0)
        texts_of = {}
        for field, parts in values.items():
            place = np.full(n, -1, dtype=np.int64)
            flat: list[str] = []
            for at, t in parts:
                place[at] = np.arange(len(flat), len(flat) + len(t))
                flat += t
            texts_of[field] = place, pa.array(flat, pa.string())

        def field_of(field: str, nodes: np.ndarray, only: np.ndarray | None = None) -> pa.Array:
            place, flat = texts_of.get(field, (np.full(n, -1, dtype=np.int64), pa.array([], pa.string())))
            p = np.where(nodes >= 0, place[nodes], -1)
            p = p if only is None else np.where(only, p, -1)
            return flat.take(pa.array(p, mask=p < 0))

        def marker_of(kind: np.ndarray, nodes: np.ndarray) -> pa.Array:
            """Marker of each node for the kind of its row."""
            out = pa.nulls(len(nodes), pa.string())
            for i, k in enumerate(kinds):
                out = pc.if_else(pa.array(kind == i), field_of(k.marker, nodes), out)
            return out

        own, kind = np.nonzero(of_kind.T)  # a row for each kind of an object
        arrays = [batch.column(i).take(pa.array(rec[own])) for i in range(len(keep))]
        outer = np.stack(near)[kind, own] if len(own) else own
        arrays += [names.take(pa.array(kind)), pa.array(number[own], pa.int32()), numbered(parent[own]), numbered(outer), marker_of(kind, outer)]
        for i, k in enumerate(kinds):
            nearest = np.where(kind == i, own, near[i][own])
            arrays += [numbered(nearest), field_of(k.marker, nearest)]
        for f in fields:
            arrays.append(field_of(f, own, np.isin(kind, [i for i, k in enumerate(kinds) if f in k.fields])))
        yield from pa.table(arrays, names=target.names).cast(target).to_batches()

    return map_arrow(df.select(*keep, F.col(text).cast("string").alias("_text")), parse, schema)
