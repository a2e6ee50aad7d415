"""Whole-batch text primitives on numpy: the texts of an Arrow batch stay one
byte buffer, and words, lines and hashes are computed for all of them at once.

A batch is worked off in pieces of about ``PIECE_BYTES`` (a longer document is a
piece of its own), so memory does not depend on the batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: Odd multiplier of the polynomial hash modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n at least, modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 64)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the maximal runs of True; a run ends with its document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans: runs without ASCII white space."""
    return runs_of(~SPACE[data], offsets)


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position belongs to."""
    return np.searchsorted(offsets, positions, side="right") - 1


def counts_to_offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of a list that is sorted by row."""
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int64)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``(value + 1) * BASE^i``; ``span_hash`` reads spans off them."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the span stands."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


#: From this many bytes on a span is identified by a digest: long texts of two letters can have equal polynomial
#: hashes modulo 2^64 under any base (a Thue-Morse word of 1,024 letters and its complement do).
LONG_SPAN = 64


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit ids of the spans by their bytes alone: the polynomial hash, and a BLAKE2b digest for long spans."""
    ids = span_hash(prefix_hash(data), starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        ids[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return ids


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) halves of the 128-bit BLAKE2b digests of the spans: equal digests stand for equal bytes."""
    raw, digest = data.tobytes(), hashlib.blake2b
    joined = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)


def fold_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive 64-bit values (length n-k+1)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = values[:n].copy()
    for i in range(1, k):
        h *= BASE
        h += values[i:n + i]
    return mix64(h)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def in_document(offsets: np.ndarray, k: int) -> np.ndarray:
    """For every start 0 .. n-k: whether the k values from there are of one document."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, dtype=bool)
    for end in offsets[1:-1]:
        ok[max(0, int(end) - k + 1):min(n, int(end))] = False
    return ok


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for every row."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[offsets[1:]] - c[offsets[:-1]]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in ascending order, index of each value among them, their counts)."""
    order = np.argsort(values)
    s = values[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(s), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return s[first], inverse, np.diff(np.append(first, len(s)))
