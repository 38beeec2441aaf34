"""Near copies of whole evaluation passages inside corpus documents, by windows of the passage's own size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.llm.leakage import WORD_CHUNK, _hashes, block_candidates, block_tables, item_blocks, words
from sparkloom.operators.arrowtools import arrow_schema, byte_pieces, map_arrow, text_array

NEAR_RADIUS = 7
_CELLS = 1 << 22  # shingles compared at once


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of `size` words, from the hashes of words."""
    n = max(0, len(h) - size + 1)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, size):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[j : n + j] + (out >> np.uint64(29)))
    return out


class PassageIndex:
    """Passages by their number of words: per length the fingerprints with radius + 1 block tables, and the sorted shingles of each passage.

    Equal passages stand once, with all items that have them.
    """

    def __init__(self, passages: list[tuple[int, str]], shingle: int, radius: int):
        self.shingle, self.radius = shingle, radius
        seen: dict[str, int] = {}
        place: dict[tuple[str, ...], int] = {}
        pairs = set()
        for item, text in passages:
            if w := tuple(words(text)):
                pairs.add((place.setdefault(w, len(place)), item))
        hashes = [_hashes(list(w), seen) for w in place]
        self.size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.shingles = [np.unique(shingle_hashes(h, min(shingle, len(h))), return_counts=True) for h in hashes]
        self.lengths = {}
        for n in np.unique(self.size).tolist():
            mine = np.flatnonzero(self.size == n)
            prints = np.concatenate([majority(np.unpackbits(hashes[i].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)[None], n) for i in mine])
            self.lengths[n] = mine, prints, block_tables(prints, radius)
        item_of = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.item_id = item_of[:, 1]
        self.item_start = np.searchsorted(item_of[:, 0], np.arange(len(hashes) + 1))


def majority(totals: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """SimHash of runs of n words from how often each bit is set in them."""
    return np.packbits(totals > (n // 2), axis=1).view(np.uint64).ravel()


def find_near_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passages: list[str], shingle: int = 5, similarity: float = 0.8, radius: int = NEAR_RADIUS) -> DataFrame:
    """Distinct (item, key) for documents in which a window as long as a passage of the item is nearly the passage.

    Near means a weighted similarity of at least `similarity` between the shingles of `shingle` words of both (of the whole, for shorter passages).
    A document shorter than the passage is one window. Method: the SimHash, by words, of every window of each length that passages have; block
    tables give all passages of that length whose fingerprint is within `radius` bits; the similarity is then computed from all shingles
    (by their 64-bit hashes). So nothing dissimilar comes out, and what is missed are near copies whose fingerprints are
    further apart: with one to three words changed in passages of 19 to 117 words, fewer than one in twenty (see the tests).

    Documents are read whole and never shuffled; items travel as in `find_leaks`. The work is the words of the corpus times the different
    lengths of passages. Null and empty texts and passages match nothing. Null keys and items are kept. Repeated rows give no
    repeated pairs. Other columns don't matter.
    """
    schema = T.StructType([T.StructField("_item", items.schema[item].dataType), T.StructField("_key", docs.schema[key].dataType)])
    make = lambda rows: PassageIndex(rows, shingle, radius)
    found = item_blocks(docs, key, text, items, item, passages, make, schema, lambda texts, shared: _search(texts, shared, schema, similarity))
    return found.distinct().select(F.col("_item").alias(item), F.col("_key").alias(key))


def _search(texts: DataFrame, shared, schema: T.StructType, similarity: float) -> DataFrame:
    target = arrow_schema(schema)
    seen: dict[str, int] = {}

    def search(batch: pa.RecordBatch):
        texts = text_array(batch.column(1))
        for i, j in byte_pieces(texts):
            yield from search_piece(batch.column(0).slice(i, j - i), texts.slice(i, j - i))

    def search_piece(keys: pa.Array, texts: pa.Array):
        index, names = shared.value
        if not index.lengths:
            return
        tokens: list[str] = []
        ends = []
        for t in texts.to_pylist():
            tokens += words(t)
            ends.append(len(tokens))
        if not tokens:
            return
        found = near_windows(index, _hashes(tokens, seen), np.array(ends), similarity)
        if not len(found):
            return
        passage, doc = found[:, 0], found[:, 1]
        count = index.item_start[passage + 1] - index.item_start[passage]
        item = index.item_id[np.repeat(index.item_start[passage], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        pairs = np.unique(np.stack([item, np.repeat(doc, count)]), axis=1)
        yield from pa.table([names.take(pa.array(pairs[0])), keys.take(pa.array(pairs[1]))], names=target.names).cast(target).to_batches()

    return map_arrow(texts, search, schema)


def near_windows(index: PassageIndex, h: np.ndarray, ends: np.ndarray, similarity: float) -> np.ndarray:
    """Different (passage, document) of the words with hashes `h`, documents ending before `ends`."""
    n = len(h)
    doc = np.searchsorted(ends, np.arange(n), "right")
    left = ends[doc] - np.arange(n)  # words from here to the end of the document
    begins = np.concatenate([[0], ends[:-1]])
    longest = max(index.lengths)
    small = longest + WORD_CHUNK < 1 << 15
    shingles: dict[int, np.ndarray] = {}
    found = [np.zeros((0, 2), dtype=np.int64)]
    for lo in range(0, n, max(WORD_CHUNK, longest)):
        hi = min(n, lo + max(WORD_CHUNK, longest))
        bits = np.unpackbits(np.ascontiguousarray(h[lo : min(n, hi + longest)]).view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(bits) + 1, 64), dtype=np.int16 if small else np.int32)
        np.cumsum(bits, axis=0, dtype=sums.dtype, out=sums[1:])
        # documents that begin here and are shorter than some passages
        short = np.arange(*np.searchsorted(begins, [lo, hi]))
        short = short[(ends[short] - begins[short] < longest) & (ends[short] > begins[short])]
        short_size = ends[short] - begins[short]
        for size, (mine, prints, tables) in index.lengths.items():
            k = min(index.shingle, size)
            if k not in shingles:
                shingles[k] = shingle_hashes(h, k)
            m = min(hi - lo, len(bits) - size + 1)
            if m > 0:
                at = np.flatnonzero(left[lo : lo + m] >= size)
                if len(at):
                    window = majority(sums[size : size + m] - sums[:m], size)[at]
                    i, j = block_candidates(window, prints, tables, index.radius)
                    _verify(index, shingles[k], k, lo + at[i], np.full(len(i), size), mine[j], doc, similarity, found)
            fit = (short_size < size) & (short_size - k + 1 >= similarity * (size - k + 1))
            if fit.any():
                b, s = begins[short[fit]], short_size[fit]
                window = majority(sums[b - lo + s].astype(np.int64) - sums[b - lo], s[:, None])
                i, j = block_candidates(window, prints, tables, index.radius)
                _verify(index, shingles[k], k, b[i], s[i], mine[j], doc, similarity, found)
    return np.unique(np.concatenate(found), axis=0)


def _verify(index: PassageIndex, shingles: np.ndarray, k: int, start: np.ndarray, size: np.ndarray, passage: np.ndarray, doc: np.ndarray, similarity: float, found: list[np.ndarray]) -> None:
    """Adds the (passage, document) of windows whose shingles are similar enough, each shingle weighing as often as it stands."""
    order = np.lexsort([size, passage])
    start, size, passage = start[order], size[order], passage[order]
    new = np.flatnonzero(np.append(True, (np.diff(passage) != 0) | (np.diff(size) != 0))) if len(start) else np.zeros(0, int)
    for a, b in zip(new, np.append(new[1:], len(start))):
        own, times = index.shingles[passage[a]]
        n = int(size[a]) - k + 1
        step = max(1, _CELLS // n)
        for s in range(a, b, step):
            at = start[s : min(b, s + step)]
            rows = shingles[at[:, None] + np.arange(n)]
            place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
            hit = own[place] == rows
            cell = (np.arange(len(at))[:, None] * len(own) + place)[hit]
            both = np.minimum(np.bincount(cell, minlength=len(at) * len(own)).reshape(len(at), -1), times).sum(axis=1)
            good = both / (n + times.sum() - both) >= similarity
            if good.any():
                d = np.unique(doc[at[good]])
                found.append(np.stack([np.full(len(d), passage[a]), d], axis=1))
