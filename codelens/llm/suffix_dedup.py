"""Suffix-array dedup of byte strings that an earlier document already has.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id.  Candidate stretches meet by their winnowing anchors (see
``winnow``); inside a bucket they are compared by a suffix sort: prefix polynomial
hashes of the concatenated stretches give the hash of any substring, a binary
search over lengths finds the common extension of two suffixes in logarithmic
time, and a mergesort of the suffixes compares them that way.  Suffixes that
agree in 50 bytes end up next to each other; every such neighbourhood is verified
byte by byte, so a hash collision can never remove anything.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.winnow import NO_ID, Chunk, Scheme, Stretches, TextStore, Windows, repeated_windows

#: Bytes of an anchor: long enough that texts seldom share one by chance.
K = 22


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Longest common prefix (at most ``limit``) of the suffixes at x and y, by
    binary search over the lengths whose hashes agree."""
    _, down = T.powers(len(prefix))
    low, step = np.zeros(len(x), dtype=np.int64), 1 << (max(limit, 1).bit_length() - 1)
    dx, dy = down[x], down[y]
    px, py = prefix[x], prefix[y]
    while step:
        at = low + step
        ok = at <= limit
        end = np.where(ok, at, 0)
        same = ok & ((prefix[x + end] - px) * dx == (prefix[y + end] - py) * dy)
        low = np.where(same, at, low)
        step >>= 1
    return low


def suffix_sort(data: np.ndarray, prefix: np.ndarray, positions: np.ndarray, blocks: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes at ``positions`` by (block, first ``limit`` bytes):
    a bottom-up mergesort of all blocks at once.  Every element finds its place in
    its partner run by binary search, each comparison by ``common_extension``."""
    order = np.argsort(blocks, kind="stable")
    b = blocks[order]
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(b)))
    start_of, size_of = np.repeat(first, size), np.repeat(size, size)
    width, widest = 1, int(size.max()) if len(size) else 0
    while width < widest:
        active = np.flatnonzero(size_of > width)
        rank = active - start_of[active]
        run = rank // width
        partner = run ^ 1
        lo = np.minimum(partner * width, size_of[active])
        hi = np.minimum(lo + width, size_of[active])
        begin = lo.copy()
        mine, left = positions[order[active]], run < partner
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) // 2
            other = positions[order[start_of[active[todo]] + mid]]
            me = mine[todo]
            n = common_extension(prefix, me, other, limit)
            equal = n >= limit
            end = np.where(equal, 0, n)
            # the partner goes first if it is smaller, or equal and the left run
            before = np.where(equal, ~left[todo], data[other + end] < data[me + end])
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
        place = start_of[active] + np.minimum(run, partner) * width + (rank - run * width) + (lo - begin)
        moved = order.copy()
        moved[place] = order[active]
        order = moved
        width *= 2
    return order


#: Windows that are sorted at once; whole anchors, so results do not depend on it.
BATCH = 300_000


def least_owner(s: Stretches, scheme: Scheme) -> list[np.ndarray]:
    """For every window of every stretch the smallest id of a document that has it."""
    out = [np.full(n, m, dtype=np.int64) for n, m in zip(s.count.tolist(), s.least.tolist())]
    _u, group, members = T.distinct(s.anchor)
    several = np.flatnonzero(members[group] > 1)
    several = several[np.argsort(group[several], kind="stable")]
    total, g = np.cumsum(s.count[several]), group[several]
    begin = 0
    while begin < len(several):
        # up to the last anchor that fits, one anchor at least
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BATCH, side="right"))
        end = max(int(np.searchsorted(g, g[min(end, len(g) - 1)])) if end < len(g) else end, int(np.searchsorted(g, g[begin], side="right")))
        _sorted_batch(s, scheme, several[begin:end], g[begin:end], out)
        begin = end
    return out


def _sorted_batch(s: Stretches, scheme: Scheme, several: np.ndarray, group: np.ndarray, out: list[np.ndarray]) -> None:
    """Suffix-sort the windows of the stretches ``several`` (anchors ``group``)
    and write the smallest owner of each neighbourhood of equal ones to ``out``."""
    texts = [s.texts[i] for i in several]
    data = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    count = s.count[several]
    owner = np.repeat(np.arange(len(several)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    positions = base[owner] + offset
    # equal windows have their anchor at the same place: only these are compared
    blocks = (group - group[0])[owner] * (scheme.length + 1) + (s.lead[several][owner] - offset)
    prefix = T.prefix_hash(data)
    order = suffix_sort(data, prefix, positions, blocks, scheme.length)
    p, b = positions[order], blocks[order]
    same = np.zeros(len(p), dtype=bool)
    near = np.flatnonzero(b[1:] == b[:-1]) + 1
    if len(near):
        near = near[common_extension(prefix, p[near - 1], p[near], scheme.length) >= scheme.length]
        span = np.arange(scheme.length)
        for i in range(0, len(near), 1 << 14):
            m = near[i:i + (1 << 14)]
            same[m] = (data[p[m - 1][:, None] + span] == data[p[m][:, None] + span]).all(axis=1)
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(s.least[several][owner][order], starts)
    flat = np.empty(len(p), dtype=np.int64)
    flat[order] = np.repeat(least, np.diff(np.append(starts, len(p))))
    for i, v in zip(several.tolist(), np.split(flat, np.cumsum(count)[:-1])):
        out[i] = v


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def repeated_spans(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on
    request, ``kept`` (the remaining bytes).

    Matches never cross documents and are judged on the input.  Null texts are
    empty; texts under ``length`` bytes are never touched; a null doc_id counts as
    larger than every other; rows with the same doc_id do not remove each other;
    a copy of a text with a smaller id goes as a whole.  Extra columns are not read.
    """
    scheme = Scheme(length, min(K, length), words=False)
    store = TextStore.build(docs)

    def finish(chunk: Chunk, windows: Windows) -> pa.Table:
        row, low, high = windows.spans(windows.value < chunk.ids[windows.row], np.array([len(t) for t in chunk.texts], np.int64), length)
        spans: list[list[tuple[int, int]]] = [[] for _ in chunk.texts]
        for r, a, b in zip(row.tolist(), low.tolist(), high.tolist()):
            spans[r].append((a, b))
        kept = [without_spans(t, s) if s else t for t, s in zip(chunk.texts, spans)]
        columns = {"h1": pa.array(chunk.h1), "h2": pa.array(chunk.h2), "least": pa.array(chunk.ids),
                   "n_removed": pa.array([len(t) - len(k) for t, k in zip(chunk.texts, kept)], pa.int64()),
                   "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                   "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_text:
            columns["kept"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    schema = "h1 long, h2 long, least long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    found = repeated_windows(store, scheme, least_owner, finish, schema)
    joined = store.rows.join(found, ["h1", "h2"], "left")
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least")) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    # a short text that a smaller id also has is not touched, but its own result may be read off that text's
    out = joined.select(
        "doc_id", "n_bytes",
        F.when(F.col("least").isNull(), 0).when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(F.col("least").isNull(), 0).when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(F.col("least").isNull() | copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(F.col("least").isNull() | copy, F.unhex(F.lit(""))).otherwise(F.col("kept")).alias("kept")] if with_text else []))
    return out
