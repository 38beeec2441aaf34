"""Evaluation passages inside corpus documents."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.arrowtools import arrow_schema, byte_pieces, map_arrow, text_array
from sparkloom.session import cut

WORDS = re.compile(r"\w+")
RADIUS = 3
ITEM_WINDOWS = 1_000_000  # windows of items that one pass over the corpus carries
WORD_CHUNK = 1 << 13  # words whose fingerprints are made at once, so that their bits stay in the cache
PAIR_CHUNK = 1 << 16


def words(text: str | None) -> list[str]:
    """The longest runs of letters, digits and _ after NFKC and lower-casing."""
    return WORDS.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def _hashes(tokens: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word; equal words are hashed once."""
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    if len(seen) > 1_000_000:
        seen.clear()
    hashed = []
    for w in coded.dictionary.to_pylist():
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w)
        hashed.append(h)
    return np.array(hashed, dtype=np.uint64)[coded.indices.to_numpy()] if hashed else np.zeros(0, dtype=np.uint64)


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each run of `window` words, from hashes of its pairs of neighbouring words (of its word, if it is one).

    Each bit is that of the majority in the run, by sums over runs of doubling length, so the cost grows with the window's logarithm.
    """
    with np.errstate(over="ignore"):
        shingle = h if window == 1 else (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
    span = max(1, window - 1)
    n = len(shingle) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for lo in range(0, n, WORD_CHUNK):
        hi = min(n, lo + WORD_CHUNK)
        part = np.ascontiguousarray(shingle[lo : hi + span - 1]).view(np.uint8).reshape(-1, 8)
        total = _sliding_sum(np.unpackbits(part, axis=1), span)
        out[lo:hi] = np.packbits(total > span // 2, axis=1).view(np.uint64).ravel()
    return out


def _sliding_sum(bits: np.ndarray, span: int) -> np.ndarray:
    """Sums over each `span` rows, put together from sums over 1, 2, 4, ... rows."""
    power = bits if span < 256 else bits.astype(np.uint16 if span < 65536 else np.uint32)
    total, done, step = None, 0, 1
    n = len(bits) - span + 1
    while True:
        if span & step:
            part = power[done : done + n]
            total = part.copy() if total is None else np.add(total, part, out=total)
            done += step
        if done == span:
            return total
        power = power[:-step] + power[step:]
        step *= 2


def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
    return (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)


def block_tables(prints: np.ndarray, radius: int) -> list[tuple]:
    """radius + 1 blocks of bits, each with a table from block value to fingerprints."""
    edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
    tables = []
    for a, b in zip(edges[:-1], edges[1:]):
        value = _block(prints, a, b)
        order = np.argsort(value, kind="stable").astype(np.int32)
        start = np.searchsorted(value[order], np.arange((1 << (b - a)) + 1)) if b - a <= 20 else None
        tables.append((a, b, value[order] if start is None else None, order, start))
    return tables


def block_candidates(probes: np.ndarray, prints: np.ndarray, tables: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe, fingerprint) within the radius. Two within it agree in at least one block, so none is missed. Fingerprints fewer than
    blocks are compared one by one, which is as good and quicker."""
    found = []
    if len(prints) <= len(tables):
        hits = [np.flatnonzero(np.bitwise_count(probes ^ p) <= radius) for p in prints]
        return np.concatenate([np.zeros(0, dtype=np.int64), *hits]), np.repeat(np.arange(len(prints)), [len(x) for x in hits])
    for a, b, sorted_values, order, start in tables:
        value = _block(probes, a, b)
        if start is None:
            lo = np.searchsorted(sorted_values, value)
            n = np.searchsorted(sorted_values, value, "right") - lo
        else:
            lo = start[value]
            n = start[value + np.uint64(1)] - lo
        hit = np.flatnonzero(n)
        for s in range(0, len(hit), PAIR_CHUNK):
            part = hit[s : s + PAIR_CHUNK]
            count = n[part]
            left = np.repeat(part, count)
            right = order[np.repeat(lo[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            near = np.bitwise_count(probes[left] ^ prints[right]) <= radius
            found.append(np.stack([left[near], right[near]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


class ItemIndex:
    """Windows of item passages under their fingerprints, with block tables. Equal windows stand once, with all items that have them."""

    def __init__(self, passages: list[tuple[int, str]], window: int, radius: int):
        self.window, self.radius = window, radius
        self.vocabulary: dict[str, int] = {}
        tokens: list[str] = []
        ids, items, ends = [], [], []
        for item, text in passages:
            w = words(text)
            if len(w) >= window:
                tokens += w
                ids += [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]
                items.append(item)
                ends.append(len(tokens))
        ids, ends = np.array(ids, dtype=np.int32), np.array(ends, dtype=np.int64)
        at = np.arange(max(0, len(tokens) - window + 1))
        owner = np.searchsorted(ends, at, "right")
        inside = at + window <= ends[owner] if len(ends) else np.zeros(0, dtype=bool)
        at, owner = at[inside], owner[inside]
        runs = ids[at[:, None] + np.arange(window)].reshape(-1, window)
        self.runs, first, place = np.unique(runs, axis=0, return_index=True, return_inverse=True) if len(runs) else (runs, at, at)
        self.prints = fingerprints(_hashes(tokens, {}), window)[at][first] if len(at) else np.zeros(0, dtype=np.uint64)
        self.tables = block_tables(self.prints, radius)
        item_of = np.unique(np.stack([place.ravel(), np.array(items, dtype=np.int64)[owner]], axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.int64)
        self.item_id = item_of[:, 1]
        self.item_start = np.searchsorted(item_of[:, 0], np.arange(len(self.prints) + 1))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of the text, window of the items) with fingerprints within the radius."""
        return block_candidates(prints, self.prints, self.tables, self.radius)


def shingle_similarity(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of the `size`-word shingles of word-id rows a and b, each shingle weighing as often as it stands;
    for windows shorter than `size`, of the whole windows."""
    size = min(size, a.shape[1])
    n = a.shape[1] - size + 1
    both = np.zeros(len(a))
    rest = np.ones((len(a), n), dtype=bool)  # shingles of b not yet matched
    for i in range(n):
        same = np.stack([(a[:, i : i + size] == b[:, j : j + size]).all(axis=1) for j in range(n)], axis=1) & rest
        first = same.argmax(axis=1)
        hit = same.any(axis=1)
        both += hit
        rest[np.flatnonzero(hit), first[hit]] = False
    return both / (2 * n - both)


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passages: list[str], window: int = 10, shingle: int = 5, similarity: float = 0.8, exact: bool = True, radius: int = RADIUS) -> DataFrame:
    """Distinct (item, key) for documents that hold a window of `window` consecutive words of a passage of the item.

    Method: SimHash of every window of passages and documents; block tables give all pairs of fingerprints within `radius`
    bits; then the exact weighted similarity of their shingles of `shingle` words must reach `similarity`. exact asks, after that, for
    the very same words in the same order; a window has the fingerprint of its equal, so none of these is missed. In short windows one
    changed word spoils most shingles: for near copies of whole passages there is `near.find_near_passages`.
    Words are as in `words`; what stands between them doesn't count.

    Documents are read whole and never shuffled. The items go to all executors in blocks of at most about ITEM_WINDOWS windows, one
    pass over the documents for each block; only items, one block at a time, reach the driver. Null and empty texts
    and passages shorter than the window match nothing. Null keys and items are kept as they are. Repeated rows give no
    repeated pairs. Other columns don't matter.
    """
    schema = T.StructType([T.StructField("_item", items.schema[item].dataType), T.StructField("_key", docs.schema[key].dataType)])
    make = lambda rows: ItemIndex(rows, window, radius)
    found = item_blocks(docs, key, text, items, item, passages, make, schema, lambda texts, shared: _search(texts, shared, schema, shingle, similarity, exact))
    return found.distinct().select(F.col("_item").alias(item), F.col("_key").alias(key))


def item_blocks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passages: list[str], make, schema: T.StructType, search) -> DataFrame:
    """The union of `search` over the texts with an index, made by `make` from (place of the item, passage), for each block of items.

    Equal rows of items count once. A text of n characters has at most n / 2 + 1 words, which bounds the windows of a block; items are spread
    over blocks by hash.
    """
    chosen = items.select(F.col(item).alias("_item"), *[F.col(p).cast("string").alias(f"_p{i}") for i, p in enumerate(passages)]).distinct()
    size = reduce(lambda a, b: a + b, [F.coalesce(F.length(f"_p{i}"), F.lit(0)).cast("long") for i in range(len(passages))])
    total = chosen.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // (2 * ITEM_WINDOWS)))
    if blocks > 1:
        chosen = cut(chosen.withColumn("_block", F.pmod(F.xxhash64("_item", *[f"_p{i}" for i in range(len(passages))]), F.lit(blocks))))
    kind = arrow_schema(schema).field(0).type
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where(F.length("_text") > 0)
    passes = []
    for block in range(blocks):
        rows = (chosen.where(F.col("_block") == block) if blocks > 1 else chosen).collect()
        index = make([(n, r[f"_p{i}"]) for n, r in enumerate(rows) for i in range(len(passages))])
        shared = docs.sparkSession.sparkContext.broadcast((index, pa.array([r["_item"] for r in rows], kind)))
        passes.append(search(texts, shared))
    return reduce(DataFrame.unionByName, passes)


def _search(texts: DataFrame, shared, schema: T.StructType, shingle: int, similarity: float, exact: bool) -> DataFrame:
    target = arrow_schema(schema)
    seen: dict[str, int] = {}

    def search(batch: pa.RecordBatch):
        texts = text_array(batch.column(1))
        for i, j in byte_pieces(texts):
            yield from search_piece(batch.column(0).slice(i, j - i), texts.slice(i, j - i))

    def search_piece(keys: pa.Array, texts: pa.Array):
        index, names = shared.value
        if not len(index.prints):
            return
        w = index.window
        tokens: list[str] = []
        ends = []
        for t in texts.to_pylist():
            tokens += words(t)
            ends.append(len(tokens))
        if len(tokens) < w:
            return
        ends = np.array(ends)
        prints = fingerprints(_hashes(tokens, seen), w)
        doc = np.searchsorted(ends, np.arange(len(prints)), "right")
        inside = np.arange(len(prints)) + w <= ends[doc]  # windows over the end of a text are none
        at = np.flatnonzero(inside)
        left, right = index.candidates(prints[at])
        left = at[left]
        get = index.vocabulary.get
        word_ids = np.full(len(tokens), -1, dtype=np.int32)
        for i in np.unique((left[:, None] + np.arange(w)).ravel()).tolist():
            word_ids[i] = get(tokens[i], -1)
        a, b = word_ids[left[:, None] + np.arange(w)], index.runs[right]
        good = np.zeros(len(left), dtype=bool)
        for s in range(0, len(left), PAIR_CHUNK):
            good[s : s + PAIR_CHUNK] = shingle_similarity(a[s : s + PAIR_CHUNK], b[s : s + PAIR_CHUNK], shingle) >= similarity
        if exact:
            good &= (a == b).all(axis=1)
        left, right = left[good], right[good]
        count = index.item_start[right + 1] - index.item_start[right]
        if not count.sum():
            return
        item = index.item_id[np.repeat(index.item_start[right], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        pairs = np.unique(np.stack([item, doc[np.repeat(left, count)]]), axis=1)
        yield from pa.table([names.take(pa.array(pairs[0])), keys.take(pa.array(pairs[1]))], names=target.names).cast(target).to_batches()

    return map_arrow(texts, search, schema)
