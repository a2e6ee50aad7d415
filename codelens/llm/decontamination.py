"""Benchmark decontamination: find the documents that contain a benchmark item.

Words are runs of letters and digits (ASCII letters lower-cased), shingles are
five consecutive words.  The windows that are considered have the size of an
item, in words.  A window contains an item if their exact weighted Jaccard
similarity reaches ``threshold``: shingles weigh as often as they occur, and the
similarity is ``sum(min) / sum(max)``.

No pair of at least that similarity is missed.  Of every item so many of its
rarest shingles are looked up that the others weigh less than ``threshold`` of it,
so a window without any of them cannot reach the threshold.  A document and an
item that share one are compared by all their shingles: the number that every
window has in common with the item is counted in one sweep over the places of
the item's shingles in the document.  The 128-bit SimHash of the shingles only
tells the ``distance`` of what was found.

The benchmark is the stated query set.  It is read in blocks of ``block_items``
items; each block is broadcast (its size is bounded by that number) and held
against all documents in one map over them, without any shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelens.llm import textops as T

SHINGLE = 5
BLOCKS = 16
#: Bits of 128, for callers that want a ``radius``.  Unrelated texts differ in 64 +- 6 bits; ordinary texts at
#: similarity 0.75 in 22 +- 4.3, texts with repeated shingles in more.  Without a ``radius`` no bits are compared.
RADIUS = 35
PIECE = 1 << 18

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word offsets by row) of a piece."""
    data = T.lower_ascii(data)
    starts, ends = T.runs_of(_WORD[data], offsets)
    return T.span_hash(T.prefix_hash(data), starts, ends), T.counts_to_offsets(T.rows_of(starts, offsets), len(offsets) - 1)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 / -1 per bit of two 64-bit hashes of every shingle, (n, 128)."""
    both = np.stack((shingles, T.mix64(shingles + np.uint64(0x5851F42D4C957F2D))), axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """(n, 128) sums -> (n, 16) bytes."""
    return np.packbits(sums > 0, axis=1)


@dataclass
class Index:
    """A block of benchmark items."""

    items: list = field(default_factory=list)          # item ids
    width: list = field(default_factory=list)          # words per item
    total: list = field(default_factory=list)          # shingles per item
    prints: list = field(default_factory=list)         # fingerprint per item
    at: np.ndarray | None = None                       # item number -> its range in keys and counts
    keys: np.ndarray | None = None                     # distinct shingles of the items, one after the other
    counts: np.ndarray | None = None                   # how often the item has them
    lookup: dict = field(default_factory=dict)         # shingle size -> (bitmap, sorted rarest shingles, their item numbers)

    @staticmethod
    def build(rows: list[tuple], threshold: float) -> "Index":
        index, keys, counts = Index(), [], []
        numbers: dict[int, list[int]] = {}
        for item, text in rows:
            h, _ = word_hashes(*T.buffer_of(pa.array([text or ""], pa.string())))
            if not len(h):
                continue
            k = min(SHINGLE, len(h))
            s = T.fold_hash(h, k)
            numbers.setdefault(k, []).append(len(index.items))
            index.items.append(item)
            index.width.append(len(h))
            index.total.append(len(s))
            index.prints.append(_fingerprint(s))
            u, n = np.unique(s, return_counts=True)
            keys.append(u)
            counts.append(n)
        index.at = np.concatenate(([0], np.cumsum([len(u) for u in keys]))).astype(np.int64)
        index.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        index.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        for k, group in numbers.items():
            _, inverse, times = np.unique(np.concatenate([keys[i] for i in group]), return_inverse=True, return_counts=True)
            rare, whose, first = [], [], 0
            for i in group:
                u, n, f = keys[i], counts[i], times[inverse[first:first + len(keys[i])]]
                first += len(u)
                order = np.argsort(f, kind="stable")
                left = index.total[i] - np.cumsum(n[order])
                some = order[:int(np.argmax(left / index.total[i] < threshold)) + 1] if threshold > 0 else order
                rare.append(u[some])
                whose.append(np.full(len(some), i, dtype=np.int64))
            table, whose = np.concatenate(rare), np.concatenate(whose)
            order = np.argsort(table, kind="stable")
            bitmap = np.zeros(1 << 22, dtype=bool)
            bitmap[(table & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            index.lookup[k] = (bitmap, table[order], whose[order])
        return index


def _fingerprint(s: np.ndarray) -> np.ndarray:
    """16 bytes, from pieces of the shingles."""
    sums = np.zeros((1, 8 * BLOCKS), dtype=np.int64)
    for i in range(0, len(s), 1 << 14):
        sums += _bits(s[i:i + (1 << 14)]).sum(axis=0, keepdims=True)
    return _fingerprints(sums)[0]


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n places each, one after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _best_window(places: list[np.ndarray], counts: list[int], shingles: int, size: int) -> tuple[int, int]:
    """(shingles in common, start) of the first of the best windows of ``size`` shingles.

    ``places`` are the places of each of the item's shingles.  Place p counts for
    a window that holds it but not the ``count``-th place before it, so for
    the starts from ``opens`` to p; the best start is one where a place opens."""
    opens, ends = [], []
    for p, c in zip(places, counts):
        a = np.maximum(p - size + 1, 0)
        a[c:] = np.maximum(a[c:], p[:-c] + 1)
        opens.append(a)
        ends.append(p)
    opens, ends = np.concatenate(opens), np.concatenate(ends)
    inside = opens <= shingles - size
    opens, ends = np.sort(opens[inside]), np.sort(ends[inside])
    low = np.searchsorted(opens, opens, "right") - np.searchsorted(ends, opens, "left")
    i = int(np.argmax(low))
    return int(low[i]), int(opens[i])


def _matches(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, radius: int | None) -> Iterator[tuple]:
    """(row, item number, start word, words, distance, similarity): the best window of each row and item."""
    h, at = word_hashes(data, offsets)
    width, total = np.array(index.width, dtype=np.int64), np.array(index.total, dtype=np.int64)
    for k, (bitmap, table, whose) in index.lookup.items():
        every = T.fold_hash(h, k)
        if not len(every):
            continue
        near = np.flatnonzero(bitmap[(every & np.uint64((1 << 22) - 1)).astype(np.int64)])
        found = every[near]
        near = near[table[np.minimum(np.searchsorted(table, found), len(table) - 1)] == found]
        row = np.searchsorted(at, near, side="right") - 1
        inside = near + k <= at[row + 1]
        near, row = near[inside], row[inside]
        for r in np.unique(row):
            rare = np.unique(every[near[np.searchsorted(row, r, "left"):np.searchsorted(row, r, "right")]])
            lo, hi = np.searchsorted(table, rare, "left"), np.searchsorted(table, rare, "right")
            numbers = np.unique(whose[_spread(lo, hi - lo)])
            s = every[at[r]:at[r + 1] - k + 1]
            order = np.argsort(s, kind="stable")
            ranked = s[order]
            # items in groups, so that a document that meets very many takes little memory
            for part in np.array_split(numbers, 1 + int((index.at[numbers + 1] - index.at[numbers]).sum()) // (1 << 20)):
                n_keys = index.at[part + 1] - index.at[part]
                key = _spread(index.at[part], n_keys)
                lo, hi = np.searchsorted(ranked, index.keys[key], "left"), np.searchsorted(ranked, index.keys[key], "right")
                ends = np.cumsum(n_keys)
                c = np.concatenate(([0], np.cumsum(np.minimum(hi - lo, index.counts[key]))))
                size = np.minimum(width[part], at[r + 1] - at[r]) - k + 1
                most = np.minimum(c[ends] - c[ends - n_keys], size)      # no window has more in common
                for i in np.flatnonzero(most / (total[part] + size - most) >= threshold):
                    no, n = int(part[i]), int(size[i])
                    held = [x for x in range(int(ends[i] - n_keys[i]), int(ends[i])) if hi[x] > lo[x]]
                    low, start = _best_window([order[lo[x]:hi[x]] for x in held], [int(index.counts[key[x]]) for x in held], len(s), n)
                    sim = low / (index.total[no] + n - low)
                    if sim < threshold:
                        continue
                    distance = int(_POPCOUNT[_fingerprint(s[start:start + n]) ^ index.prints[no]].sum())
                    if radius is None or distance <= radius:
                        yield int(r), no, start, n + k - 1, distance, sim


def _blocks(benchmark: DataFrame, block_items: int, threshold: float) -> Iterator[Index]:
    rows: list[tuple] = []
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block_items:
            yield Index.build(rows, threshold)
            rows = []
    if rows:
        yield Index.build(rows, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int | None = None,
               block_items: int = 20_000) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, start_word,
    n_words, distance (bits), similarity, of the most similar window (the first on ties).
    With a ``radius`` only rows within that distance are given.

    Items and documents with fewer than five words are one shingle; texts
    without words, null or empty, match nothing.  Repeated documents and items
    give a row each.  Long texts are searched to their end.  Empty tables give an
    empty result; columns other than the ids and texts are not read.
    """
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, n_words long, distance int, similarity double"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                data, offsets = T.buffer_of(batch.column("text"))
                found = [(i + m[0], *m[1:]) for i, _j, part, at in T.pieces(data, offsets, PIECE)
                         for m in _matches(index, part, at, threshold, radius)]
                rows, items, *rest = zip(*found) if found else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                     pa.array([index.items[i] for i in items], _arrow(kinds[1]))]
                    + [pa.array(v, t) for v, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))],
                    ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])
        return run

    parts = [docs.select("doc_id", "text").mapInArrow(search(spark.sparkContext.broadcast(index)), schema)
             for index in _blocks(benchmark, block_items, threshold)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int | None = None,
                  block_items: int = 20_000) -> DataFrame:
    """The documents in which ``find_leaks`` finds nothing, columns unchanged."""
    names = docs.columns

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                data, offsets = T.buffer_of(batch.column(names.index("text")))
                keep = np.ones(len(offsets) - 1, dtype=bool)
                for i, _j, part, at in T.pieces(data, offsets, PIECE):
                    keep[[i + m[0] for m in _matches(index, part, at, threshold, radius)]] = False
                yield batch.filter(pa.array(keep))
        return run

    out = docs
    for index in _blocks(benchmark, block_items, threshold):
        out = out.mapInArrow(search(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
