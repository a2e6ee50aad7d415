"""Texts in co-located chunks, and the places where they share passages.

Repeated passages of at least ``length`` units (bytes or words) are found in
four steps that never hold more than a chunk or a bucket in one task:

1. ``TextStore``: every distinct text once, compressed, in a table bucketed by
   ``chunk``; the later steps read it in place.  Equal texts meet in one chunk and
   are already merged per batch, so a large group of copies is no hot spot.
2. Winnowing: in every window of ``length`` units the k-gram with the smallest
   hash is its anchor (the leftmost on ties).  Equal windows have equal anchors, so
   a window can only recur if its anchor does.  Chunks send their anchors to
   buckets by hash, sorted and delta-coded to two or three bytes each, and get
   back two bits each: alone, shared, or hot (very many occurrences).
3. The stretches of text around shared anchors go to the anchor's bucket, once
   per chunk and content.  Around hot anchors single windows go, each to the bucket
   of its own content, so that no bucket has to hold all surroundings of a
   common passage.  The operator's ``solve`` compares what met in a bucket.
4. The answers go back to the chunks, which put them together per text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.store import bucketed, materialize

CHUNK_BYTES = 8 << 20
NO_ID = (1 << 63) - 1                     # a null doc_id is larger than every other
HOT = 1024
PIECE = 1 << 17
_WEIGHT = np.array([1, 2, 16, 256])       # least number of occurrences of a count class


@dataclass
class TextStore:
    """rows: (doc_id, h1, h2, n_bytes) per input row; table: (chunk, h1, h2, doc_id,
    body) per distinct non-empty text, where doc_id is the smallest."""

    rows: DataFrame
    table: DataFrame
    chunks: int

    @staticmethod
    def build(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> "TextStore":
        text = F.coalesce(F.col("text"), F.lit(""))
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"),
                            F.xxhash64(F.lit(7), text).alias("h2"), text.alias("text"))
        rows = materialize(named.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes")))
        total = rows.agg(F.sum("n_bytes")).first()[0] or 0
        chunks = max(8, -(-int(total) // chunk_bytes))
        chunks = min(chunks, int(docs.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        packed = (named.where(F.col("text") != "")
                  .select(F.expr(f"int(pmod(h1, {chunks}L))").alias("chunk"), "h1", "h2",
                          F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
                  .mapInArrow(_pack, "chunk int, h1 long, h2 long, doc_id long, body binary"))
        return TextStore(rows, bucketed(packed, "chunk", chunks), chunks)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a batch once, with the smallest id, compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, h1, h2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        order = np.lexsort((ids, h2, h1))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        at = order[first]
        texts = batch.column(4)
        body = [press.compress(texts[int(i)].as_buffer()) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[at]), pa.array(h1[at]), pa.array(h2[at]), pa.array(ids[at]),
                                          pa.array(body, pa.binary())], ["chunk", "h1", "h2", "doc_id", "body"])


@dataclass
class Chunk:
    """The distinct texts of a chunk, in the order of their hashes."""

    h1: np.ndarray
    h2: np.ndarray
    ids: np.ndarray
    texts: list[bytes]

    @staticmethod
    def load(table: pa.Table, normalise: Callable[[bytes], bytes] | None = None) -> "Chunk":
        h1, h2, ids = (table.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        order = np.lexsort((ids, h2, h1))
        first = np.ones(len(order), dtype=bool)
        if len(order):
            first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        order = order[first]
        body, unpack = table.column("body"), zstandard.ZstdDecompressor()
        texts = [unpack.decompress(body[int(i)].as_py()) for i in order]
        if normalise:
            texts = [normalise(t) for t in texts]
        return Chunk(h1[order], h2[order], ids[order], texts)

    def pieces(self, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, bytes, offsets) of consecutive texts."""
        i = 0
        while i < len(self.texts):
            j, size = i, 0
            while j < len(self.texts) and (j == i or size + len(self.texts[j]) <= limit):
                size += len(self.texts[j])
                j += 1
            part = self.texts[i:j]
            yield (i, np.frombuffer(b"".join(part), dtype=np.uint8),
                   np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64))
            i = j


# --- keys that occur more than once -------------------------------------------------

def pack32(keys: np.ndarray) -> bytes:
    """32-bit values in ascending order as deltas, byte plane by byte plane."""
    delta = np.diff(keys.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack32(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint64)


def below_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits that follow the bucket's leading bits."""
    return (keys >> np.uint64(32 - (buckets.bit_length() - 1))) & np.uint64(0xFFFFFFFF)


def _pack2(values: np.ndarray) -> bytes:
    """Two bits each, four to a byte."""
    v = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    v[:len(values)] = values
    v = v.reshape(-1, 4)
    return (v[:, 0] | v[:, 1] << 2 | v[:, 2] << 4 | v[:, 3] << 6).tobytes()


def _unpack2(blob: bytes, n: int) -> np.ndarray:
    v = np.frombuffer(blob, dtype=np.uint8)
    return np.stack((v & 3, v >> 2 & 3, v >> 4 & 3, v >> 6), axis=1).reshape(-1)[:n]


def key_buckets(chunks: int) -> int:
    """Number of buckets (a power of two) for ``chunks`` chunks."""
    return 1 << max(3, (chunks - 1).bit_length())


def split_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted 64-bit keys; a bucket is the leading bits."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64), side="left")


def _table(**columns) -> pa.Table:
    kinds = {"chunk": pa.int32(), "bucket": pa.int32(), "kind": pa.int32(), "blob": pa.binary(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})


def shared_keys(store: TextStore, keys_of: Callable[[Chunk], tuple[np.ndarray, bytes | None]], normalise: Callable | None,
                buckets: int, steps: tuple[int, ...] = (2, HOT + 1)) -> DataFrame:
    """(chunk, bucket, blob): for every distinct key of a chunk, in ascending
    order, how many of ``steps`` its number of occurrences in all chunks reaches
    (counted from below: large counts of a chunk enter as 2, 16 or 256).

    ``keys_of`` gives a chunk's keys with repeats, and optionally a note that comes
    back as the chunk's row with bucket ``-1 - chunk``.  Keys are compared by their
    bucket and 32 further bits, so about one in some thousands counts too high;
    that costs work, never a result.
    """
    def send(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        keys, note = keys_of(Chunk.load(table, normalise))
        u, _inverse, n = T.distinct(keys)
        level = np.searchsorted(_WEIGHT, n, side="right") - 1
        cut = split_keys(u, buckets)
        low = below_bucket(u, buckets)
        used = np.flatnonzero(np.diff(cut)).tolist()
        rows = [(chunk, b, pack32(low[cut[b]:cut[b + 1]]), _pack2(level[cut[b]:cut[b + 1]])) for b in used]
        if note is not None:
            rows.append((chunk, -1 - chunk, note, b""))
        a, b, k, c = zip(*rows) if rows else ((),) * 4
        return _table(chunk=a, bucket=b, keys=k, counts=c)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["chunk", "bucket", "keys"]).rename_columns(["chunk", "bucket", "blob"])
        parts = [unpack32(k) for k in table.column("keys").to_pylist()]
        counts = [_WEIGHT[_unpack2(c, len(p))] for c, p in zip(table.column("counts").to_pylist(), parts)]
        every, weight = np.concatenate(parts), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        s = every[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        total = np.add.reduceat(weight[order], first)
        level = np.searchsorted(np.array(steps), total, side="right").astype(np.uint8)
        out = np.empty(len(every), dtype=np.uint8)
        out[order] = np.repeat(level, np.diff(np.append(first, len(s))))
        ends = np.cumsum([0] + [len(p) for p in parts])
        return _table(chunk=table.column("chunk").to_pylist(), bucket=table.column("bucket").to_pylist(),
                      blob=[_pack2(out[a:b]) for a, b in zip(ends[:-1], ends[1:])])

    sent = store.table.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, blob binary")


def key_levels(keys: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """The answers of ``shared_keys`` for a chunk's sorted distinct keys."""
    cut = split_keys(keys, buckets)
    out = np.zeros(len(keys), dtype=np.uint8)
    for b, blob in answers.items():
        out[cut[b]:cut[b + 1]] = _unpack2(blob, cut[b + 1] - cut[b])
    return out


# --- anchors ------------------------------------------------------------------------

def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by doubling (length n-k+1)."""
    size, h = 1, values
    out, done = None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:  # `size` values from here, then the `done` values after them
                n = len(values) - done - size + 1
                out, done = h[:n] * _power(done) + out[size:size + n], done + size
        if size * 2 > k:
            return T.mix64(out)
        h = h[:-size] * _power(size) + h[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(T.BASE), n, 1 << 64))


def leftmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value (by its leading 32 bits) of every w
    consecutive ones: minima of value and position in one number, by doubling."""
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < w:
        s = min(span, w - span)
        key = np.minimum(key[s:], key[:-s])
        span += s
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Scheme:
    """What a passage is: ``length`` units; anchors are ``k``-grams of units."""

    length: int
    k: int
    words: bool

    def normalise(self, text: bytes) -> bytes:
        """The text that spans refer to: as it is, or its words joined by one space."""
        return b" ".join(text.split()) if self.words else text

    def anchors(self, chunk: Chunk) -> "Anchors":
        ids, row, start, count, lead, low, high = [], [], [], [], [], [], []
        for first, data, offsets in chunk.pieces(PIECE):
            if self.words:
                a, b = T.words_of(data, offsets)
                units, at = T.span_hash(T.prefix_hash(data), a, b), T.counts_to_offsets(T.rows_of(a, offsets), len(offsets) - 1)
            else:
                a = b = None
                units, at = data.astype(np.uint64) + np.uint64(1), offsets
            n = len(units) - self.length + 1
            if n <= 0:
                continue
            grams = rolling(units, self.k)
            best = leftmost_minimum(grams, self.length - self.k + 1)[:n]
            inside = np.flatnonzero(T.in_document(at, self.length))
            if not len(inside):
                continue
            best = best[inside]
            new = np.ones(len(inside), dtype=bool)
            new[1:] = best[1:] != best[:-1]
            s = np.flatnonzero(new)
            size = np.diff(np.append(s, len(inside)))
            s0, p = inside[s], best[s]
            o = np.searchsorted(at, s0, side="right") - 1
            ids.append(T.mix64(grams[p] + np.uint64(0x632BE59BD9B4E019)))
            row.append(o + first)
            start.append(s0 - at[o])
            count.append(size)
            lead.append(p - s0)
            last = s0 + size + self.length - 2
            low.append((a[s0] if self.words else s0) - offsets[o])
            high.append((b[last] if self.words else last + 1) - offsets[o])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return Anchors(join(ids).astype(np.uint64), *(join(x).astype(np.int64) for x in (row, start, count, lead, low, high)))


@dataclass
class Anchors:
    """Per anchor: id, text, first window start and number of windows (in units),
    units from the first start to the anchor, and the bytes [low, high) of the text
    that its windows cover."""

    ids: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    low: np.ndarray
    high: np.ndarray


# --- stretches ------------------------------------------------------------------------

@dataclass
class Stretches:
    """The distinct stretches that one chunk sends to one bucket."""

    anchor: np.ndarray       # uint64
    lead: np.ndarray
    count: np.ndarray        # windows
    least: np.ndarray        # smallest doc_id in the chunk
    seen: np.ndarray         # occurrences in the chunk, 2 for more
    texts: list[bytes]

    def dump(self, press: zstandard.ZstdCompressor) -> bytes:
        n = np.array([len(self.texts)], dtype=np.int64)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        return press.compress(b"".join([n.tobytes(), self.anchor.astype(np.uint64).tobytes(),
                                        *(x.astype(np.int64).tobytes() for x in (self.lead, self.count, self.least, self.seen, sizes)),
                                        *self.texts]))

    @staticmethod
    def read(blob: bytes) -> "Stretches":
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        anchor = np.frombuffer(raw, np.uint64, n, 8)
        lead, count, least, seen, sizes = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * (i + 1)) for i in range(5))
        ends = 8 + 48 * n + np.concatenate(([0], np.cumsum(sizes)))
        return Stretches(anchor, lead, count, least, seen, [raw[a:b] for a, b in zip(ends[:-1], ends[1:])])


def _windows_of(text: bytes, scheme: Scheme, count: int) -> list[bytes]:
    if not scheme.words:
        return [text[i:i + scheme.length] for i in range(count)]
    words = text.split(b" ")
    return [b" ".join(words[i:i + scheme.length]) for i in range(count)]


@dataclass
class Occurrences:
    """Where a chunk's stretches stand: bucket, number in the bucket, text, first window; in a fixed order."""

    bucket: np.ndarray
    number: np.ndarray
    row: np.ndarray
    start: np.ndarray


def _stretches(chunk: Chunk, scheme: Scheme, answers: dict[int, bytes], keys_in: int, buckets: int) -> tuple[dict[int, Stretches], Occurrences]:
    """The stretches around shared anchors (told by ``answers`` from ``keys_in``
    buckets of keys) by bucket of stretches, and where they stand."""
    anchors = scheme.anchors(chunk)
    keys, inverse, _n = T.distinct(anchors.ids)
    level = key_levels(keys, answers, keys_in)[inverse]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    known: dict[tuple, int] = {}
    names, leads, counts, least, seen, bodies = [], [], [], [], [], []
    ids, texts = chunk.ids.tolist(), chunk.texts

    def number(text: bytes, lead: int, anchor: int, count: int, owner: int) -> int:
        key = (text, lead, anchor)
        no = known.get(key)
        if no is None:
            known[key] = no = len(names)
            names.append(anchor)
            leads.append(lead)
            counts.append(count)
            least.append(owner)
            seen.append(1)
            bodies.append(text)
        else:
            seen[no] = 2
            if owner < least[no]:
                least[no] = owner
        return no

    def columns(picked: np.ndarray):
        return zip(anchors.ids[picked].tolist(), *(x[picked].tolist() for x in (anchors.row, anchors.start, anchors.count,
                                                                                anchors.lead, anchors.low, anchors.high)))

    shared, hot = np.flatnonzero(level == 1), np.flatnonzero(level > 1)
    found = [number(texts[r][a:b], lead, key, count, ids[r]) for key, r, _s, count, lead, a, b in columns(shared)]
    rows, starts = [anchors.row[shared]], [anchors.start[shared]]
    for _key, r, start, count, _lead, a, b in columns(hot):
        found += [number(w, 0, xxhash.xxh3_64_intdigest(w), 1, ids[r]) for w in _windows_of(texts[r][a:b], scheme, count)]
        rows.append(np.full(count, r))
        starts.append(np.arange(start, start + count))
    name = np.array(names, dtype=np.uint64)
    home = (name >> shift).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(buckets + 1))
    place = np.empty(len(name), dtype=np.int64)
    place[order] = np.arange(len(name)) - cut[home[order]]
    parts = [np.array(x, dtype=np.int64) for x in (leads, counts, least, seen)]
    packed = {}
    for b in np.flatnonzero(np.diff(cut)).tolist():
        mine = order[cut[b]:cut[b + 1]]
        packed[b] = Stretches(name[mine], *(x[mine] for x in parts), [bodies[i] for i in mine.tolist()])
    at = np.array(found, dtype=np.int64)
    return packed, Occurrences(home[at], place[at], np.concatenate(rows), np.concatenate(starts))


@dataclass
class Windows:
    """Runs of consecutive windows with the same value: text, first window, number of windows, value."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    value: np.ndarray

    def spans(self, picked: np.ndarray, units: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first unit, end unit) of the maximal runs that the picked windows
        cover, for texts of ``units`` units each."""
        at = np.concatenate(([0], np.cumsum(units))).astype(np.int64)
        low = at[self.row[picked]] + self.start[picked]
        high = low + self.count[picked] - 1 + length
        edge = np.bincount(low, minlength=at[-1] + 1) - np.bincount(high, minlength=at[-1] + 1)
        first, last = T.runs_of(np.cumsum(edge[:-1]) > 0, at)
        row = T.rows_of(first, at)
        return row, first - at[row], last - at[row]


Solve = Callable[[Stretches, Scheme], list[np.ndarray]]


def repeated_windows(store: TextStore, scheme: Scheme, solve: Solve, finish: Callable[[Chunk, Windows], pa.Table], schema: str) -> DataFrame:
    """Run the four steps.

    ``solve`` gets the distinct stretches of a bucket (over all chunks) and returns
    one value per window of each.  ``finish`` gets a chunk and the values of its
    windows and returns rows of ``schema``.
    """
    keys_in = key_buckets(store.chunks)
    # stretches compress better together: fewer buckets than for the bare keys, still in step with the data
    buckets = key_buckets(-(-store.chunks // 2))
    masks = materialize(shared_keys(store, lambda c: (scheme.anchors(c).ids, None), scheme.normalise, keys_in))

    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        press = zstandard.ZstdCompressor(level=3)
        packed, _where = _stretches(Chunk.load(table, scheme.normalise), scheme, got, keys_in, buckets)
        return _table(chunk=[key[0].as_py()] * len(packed), bucket=list(packed), blob=[s.dump(press) for s in packed.values()])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        parts = [Stretches.read(b) for b in table.column("blob").to_pylist()]
        merged, number = _merge(parts)
        values = solve(merged, scheme)
        press = zstandard.ZstdCompressor(level=3)
        blobs = [press.compress(_runs([values[i] for i in n])) for n in number]
        chunks = table.column("chunk").to_pylist()
        return _table(chunk=chunks, kind=[1] * len(chunks), bucket=[key[0].as_py()] * len(chunks), blob=blobs)

    def collect(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, where_from, blobs = (answers.column(c).to_pylist() for c in ("kind", "bucket", "blob"))
        got = {b: x for k, b, x in zip(kinds, where_from, blobs) if k == 0}
        unpack = zstandard.ZstdDecompressor()
        values = {b: _unruns(unpack.decompress(x)) for k, b, x in zip(kinds, where_from, blobs) if k == 1}
        chunk = Chunk.load(table, scheme.normalise)
        where = _stretches(chunk, scheme, got, keys_in, buckets)[1]
        order = np.argsort(where.bucket, kind="stable")
        cut = np.searchsorted(where.bucket[order], np.arange(buckets + 1))
        parts: list[tuple] = []
        for b, (runs, value, offset, length) in values.items():
            mine = order[cut[b]:cut[b + 1]]
            first, n = runs[where.number[mine]], runs[where.number[mine] + 1] - runs[where.number[mine]]
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            parts.append((np.repeat(where.row[mine], n), np.repeat(where.start[mine], n) + offset[at], length[at], value[at]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        return finish(chunk, Windows(*columns))

    chunks = store.table.groupBy("chunk")
    sent = chunks.cogroup(masks.groupBy("chunk")).applyInArrow(send, "chunk int, bucket int, blob binary")
    replies = sent.groupBy("bucket").applyInArrow(compare, "chunk int, kind int, bucket int, blob binary")
    both = masks.select("chunk", F.lit(0).alias("kind"), "bucket", "blob").unionByName(replies)
    return chunks.cogroup(both.groupBy("chunk")).applyInArrow(collect, schema)


def _merge(parts: list[Stretches]) -> tuple[Stretches, list[list[int]]]:
    """Distinct stretches over all chunks, and each part's numbers in them."""
    known: dict[tuple, int] = {}
    first: list[tuple[int, int]] = []
    numbers = []
    for i, p in enumerate(parts):
        mine = []
        for j, key in enumerate(zip(p.texts, p.lead.tolist(), p.anchor.tolist())):
            no = known.setdefault(key, len(known))
            if no == len(first):
                first.append((i, j))
            mine.append(no)
        numbers.append(mine)
    sizes = np.cumsum([0] + [len(p.texts) for p in parts])
    pick = np.array([sizes[i] + j for i, j in first], dtype=np.int64)
    every = np.concatenate([np.array(m, dtype=np.int64) for m in numbers])
    join = lambda f: np.concatenate([getattr(p, f) for p in parts])
    least = np.full(len(first), NO_ID, dtype=np.int64)
    np.minimum.at(least, every, join("least"))
    seen = np.bincount(every, weights=join("seen"), minlength=len(first)).astype(np.int64)
    return Stretches(join("anchor")[pick], join("lead")[pick], join("count")[pick], least, np.minimum(seen, 2),
                     [parts[i].texts[j] for i, j in first]), numbers


def _runs(values: list[np.ndarray]) -> bytes:
    """Arrays as runs: their number, the number of runs of each, then value, offset
    in the array and length of each run."""
    every = np.concatenate(values) if values else np.zeros(0, np.int64)
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    new[begin[sizes > 0]] = True
    at = np.flatnonzero(new)
    runs = np.searchsorted(at, np.append(begin, len(every)))
    owner = np.searchsorted(begin, at, side="right") - 1
    return b"".join(x.astype(np.int64).tobytes() for x in (np.array([len(sizes), len(at)]), runs, every[at], at - begin[owner],
                                                           np.diff(np.append(at, len(every)))))


def _unruns(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each array's runs, value, offset, length of each run)."""
    n, m = np.frombuffer(raw, np.int64, 2)
    return (np.frombuffer(raw, np.int64, n + 1, 16), *(np.frombuffer(raw, np.int64, m, 16 + 8 * (n + 1) + 8 * m * i) for i in range(3)))
