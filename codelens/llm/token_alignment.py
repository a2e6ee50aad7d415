"""Cross-tokenizer alignment by galloping intersection of token ends.

Both tokenizers turn a text into tokens that cover the same bytes; every token
is known by the byte offset where it ends.  The shorter list of ends drives an
exponential search, then a binary search, into the longer one.  Offsets found
in both cut the two token lists into groups; the rank that an end has in the
other list, less the rank of the end before it, is the range of tokens that its
token overlaps.

Texts are never held as tokens as a whole: a text is cut in front of single
spaces between two other characters, where a token of either vocabulary must
end (no piece has a space behind another character, and the pattern of the byte
vocabulary starts a new piece at every space), so a cut changes no token.  Equal
segments of a window of texts are encoded once; a very long text is worked off
window by window.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.store import materialize
from codelens.session import ensure_checkpoint_dir

#: Bytes of text that are aligned at a time.
WINDOW = 2 << 20
#: Segments that the piece vocabulary encodes as one text (its time per byte grows with the text).
JOINED = 32
#: Linked id pairs that are broadcast at a time (16 bytes each).
SLICE_PAIRS = 1 << 21
#: Linked id pairs that a task adds up before it passes them on.
TASK_PAIRS = 1 << 20

SPACE = 0x20
_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[0x21:0x7F] = True
#: First bytes of characters that may be white space outside ASCII, and of the piece vocabulary's own space sign.
_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])

#: Bytes that do not keep a segment from being encoded joined with others: printing ASCII, tab and line ends, and those of
#: U+00A1 .. U+024F, whose categories no Unicode version changes.
_STABLE = np.zeros(256, dtype=bool)
_STABLE[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA)]] = True
_NO_SPACE = _STABLE.copy()
_NO_SPACE[[0x09, 0x0A, 0x0D, 0x20]] = False
# Fixed value: the published pattern of byte-level vocabularies with a regex pre-tokenizer.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every value of ``short`` the index of the first value of ``long`` that is
    not smaller.  Both ascend.  The search begins at ``start``, doubles its step
    until the value is passed, then halves the interval; all values at once."""
    n = len(long)
    lo, hi = np.zeros(len(short), np.int64), np.full(len(short), n, np.int64)
    if n == 0 or not len(short):
        return lo
    at = np.clip(start, 0, n - 1)
    right = long[at] < short  # the answer lies behind `at`
    lo[right], hi[~right] = at[right] + 1, at[~right]
    step = 1
    todo = np.arange(len(short))
    while len(todo):
        r = right[todo]
        probe = np.where(r, at[todo] + step, at[todo] - step)
        inside = (probe >= 0) & (probe < n)
        todo, r, probe = todo[inside], r[inside], probe[inside]
        smaller = long[probe] < short[todo]
        lo[todo[smaller]] = np.maximum(lo[todo[smaller]], probe[smaller] + 1)
        hi[todo[~smaller]] = np.minimum(hi[todo[~smaller]], probe[~smaller])
        todo = todo[smaller == r]  # not passed yet
        step *= 2
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        smaller = long[mid] < short[todo]
        lo[todo[smaller]], hi[todo[~smaller]] = mid[smaller] + 1, mid[~smaller]
        todo = todo[lo[todo] < hi[todo]]
    return lo


def intersect(ends_a: np.ndarray, ends_b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the common ends in either list.  Both lists ascend over all rows;
    ``rows`` give the row (text) of each end.  In every row the shorter list drives."""
    count_a, count_b = np.bincount(rows_a, minlength=n_rows), np.bincount(rows_b, minlength=n_rows)
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    a_short = count_a <= count_b
    out = []
    for short, long, rows, drives, counts, other, first, first_other in (
            (ends_a, ends_b, rows_a, a_short, count_a, count_b, first_a, first_b),
            (ends_b, ends_a, rows_b, ~a_short, count_b, count_a, first_b, first_a)):
        mine = np.flatnonzero(drives[rows])
        r = rows[mine]
        guess = first_other[r] + (mine - first[r]) * other[r] // np.maximum(counts[r], 1)
        at = gallop(short[mine], long, guess)
        hit = at < len(long)
        hit[hit] = long[at[hit]] == short[mine[hit]]
        out.append((mine[hit], at[hit]))
    a, b = np.concatenate((out[0][0], out[1][1])), np.concatenate((out[0][1], out[1][0]))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of the list ``short`` of ends the tokens [first, end) of ``long`` that share bytes with it."""
    at = gallop(short, long, np.arange(len(short)) * max(len(long), 1) // max(len(short), 1))
    shared = np.zeros(len(short), dtype=bool)
    inside = at < len(long)
    shared[inside] = long[at[inside]] == short[inside]
    first = np.concatenate(([0], (at + shared)[:-1])) if len(short) else at
    return first, np.minimum(at + 1, len(long))


def _byte_of_sign() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies, reversed: bytes that
    print stand for themselves, the others follow from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in printing}
    others = (b for b in range(256) if b not in set(printing))
    return signs | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class _Tokens:
    """Ids of distinct segments: ``counts`` of them from ``first`` on."""
    ids: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per code) of the segments that the codes name, one after the other."""
        counts = self.counts[codes]
        start = np.cumsum(counts) - counts
        return self.ids[np.arange(int(counts.sum())) + np.repeat(self.first[codes] - start, counts)], counts


def _joinable(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Segments with no space behind the first or at the end, all of whose characters are stable:
    one after the other they are encoded as each by itself."""
    good = _STABLE[data]
    good[:-1] &= ~((data[:-1] == 0xC2) & (data[1:] < 0xA1))
    bad = np.concatenate(([0], np.cumsum(~good)))
    size = np.diff(offsets)
    last = np.maximum(offsets[1:] - 1, 0)
    second = np.minimum(offsets[:-1] + 1, max(len(data) - 1, 0))
    return (size > 1) & (bad[offsets[1:]] == bad[offsets[:-1]]) & _NO_SPACE[data[second]] & _NO_SPACE[data[last]] if len(data) else size > 1


class Encoders:
    """The two tokenizers, from their files' contents."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_proto=piece_model)
        signs = _byte_of_sign()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(signs[c] for c in names[i]) if i in names and all(c in signs for c in names[i]) else names.get(i, "").encode()
                        for i in range(max(names) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        split = json.loads(byte_json)
        kind = split.get("pre_tokenizer") or {}
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        #: whether texts may be cut at spaces
        self.cuttable = (split.get("normalizer") is None and kind.get("type") == "ByteLevel" and bool(kind.get("use_regex"))
                         and not kind.get("add_prefix_space") and not any("▁" in p.lstrip("▁") for p in pieces)
                         and "".join(self.b.encode(" a  ﬁ b", out_type=str)) == "▁▁a▁▁ﬁ▁b")
        self.fast = self._ranks(split) if self.cuttable else None
        # ids in decimal with what follows them: within a side, and at the end of a side
        self.words = pa.array([f"{i}{x}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for i in range(n) for x in (",", last)])
        self.word_size = pc.binary_length(self.words).to_numpy().astype(np.int64)

    def _ranks(self, split: dict):
        """An encoder by ranks for the same vocabulary, or None where it might differ.

        Merging by the rank of the merged token and merging by listed pairs agree if
        every token comes from one pair, ranks follow the list, and each token's own
        bytes are encoded as that token: then a pair that makes a token is its listed pair.
        """
        import tiktoken

        model = split["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"].get("".join(p)) for p in pairs]
        words = sorted(model["vocab"].items(), key=lambda x: x[1])
        single, merged = [t for t, _i in words if len(t) == 1], set(ids)
        if (model.get("type", "BPE") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or None in ids
                or ids != sorted(set(ids)) or len(single) != 256
                or any([k.id for k in self.a.model.tokenize(t)] != [i] for t, i in words if i in merged or len(t) == 1)):
            return None
        ranks = {self.bytes_a[i]: i for t, i in words if i in merged or len(t) == 1}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, segments: pa.LargeBinaryArray) -> tuple[_Tokens, _Tokens]:
        """The tokens of distinct segments that start with a space, on either side; none
        on either where the tokens' bytes are not those of the segment."""
        data, offsets = T.buffer_of(segments)
        plain = _joinable(data, offsets) if self.cuttable else np.zeros(len(segments), bool)
        kept = data[np.repeat(plain, np.diff(offsets))].tobytes()
        ends = np.cumsum(np.diff(offsets)[plain])
        a = b = None
        if kept:  # cut again where the segments end: there a token ends on both sides
            text = kept.decode()
            a = np.array(self.fast.encode_ordinary(text) if self.fast is not None else self.a.encode(text, add_special_tokens=False).ids, np.int64)
            some = [0, *ends[JOINED - 1:-1:JOINED].tolist(), len(kept)]
            b = np.fromiter(chain.from_iterable(self.b.encode([kept[i + 1:j].decode() for i, j in zip(some, some[1:])])), np.int64)
            if not b"".join([self.bytes_a[i] for i in a.tolist()]) == kept == b"".join([self.bytes_b[i] for i in b.tolist()]):
                plain, a, b = np.zeros(len(segments), bool), None, None
        single = segments.filter(pa.array(~plain)).to_pylist()
        texts = [s.decode() for s in single]
        left = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        right = self.b.encode([t[1:] for t in texts]) if texts else []
        for i, (s, x, y) in enumerate(zip(single, left, right)):
            if not b"".join([self.bytes_a[k] for k in x]) == s == b"".join([self.bytes_b[k] for k in y]):
                left[i], right[i] = [], []
        out = []
        for size, ids, others in ((self.size_a, a, left), (self.size_b, b, right)):
            counts = np.zeros(len(segments), np.int64)
            if ids is None:
                ids = np.zeros(0, np.int64)
            else:
                counts[plain] = np.diff(np.searchsorted(np.cumsum(size[ids]), ends) + 1, prepend=0)
            counts[~plain] = list(map(len, others))
            first = np.zeros(len(segments), np.int64)
            first[plain] = np.cumsum(counts[plain]) - counts[plain]
            first[~plain] = len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
            out.append(_Tokens(np.concatenate((ids, np.fromiter(chain.from_iterable(others), np.int64))), first, counts))
        return out[0], out[1]


_encoders: dict[str, Encoders] = {}


def cuts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the segments: the texts' own, and single spaces between two characters that are no white space."""
    b = np.flatnonzero(data[1:-1] == SPACE) + 1
    before, after = data[b - 1], data[b + 1]
    plain = _ASCII_WORD[before] | ((before >= 0x80) & ~_LEADS[data[np.maximum(b - 2, 0)]] & ~_LEADS[data[np.maximum(b - 3, 0)]])
    good = b[plain & (_ASCII_WORD[after] | ((after >= 0x80) & ~_LEADS[after]))]
    cut = np.zeros(len(data), dtype=bool)
    cut[good] = cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class _Row:
    """What has been found of one text."""

    def __init__(self, keep: bool):
        self.a = self.b = self.groups = 0
        self.ok, self.sha, self.text = True, hashlib.sha256(), [] if keep else None
        self.keys, self.counts = [], []

    def add(self, a: int, b: int, groups: int, told: bytes, keys: np.ndarray) -> None:
        if told:
            if self.groups:
                self.sha.update(b";")
            self.sha.update(told[:-1])
            if self.text is not None:
                self.text.append(told)
        self.a, self.b, self.groups = self.a + a, self.b + b, self.groups + groups
        u, c = np.unique(keys, return_counts=True)
        self.keys.append(u)
        self.counts.append(c)
        if len(self.keys) > 64:
            self.pack()

    def pack(self) -> None:
        if len(self.keys) > 1:
            u, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.counts = [u], [np.bincount(inverse, weights=np.concatenate(self.counts)).astype(np.int64)]

    def row(self) -> tuple:
        if not self.ok or not self.groups:
            return 0, 0, 0, "", "", b"", b""
        self.pack()
        return (self.a, self.b, self.groups, self.sha.hexdigest(), b"".join(self.text)[:-1].decode() if self.text is not None else "",
                self.keys[0].astype(np.int64).tobytes(), self.counts[0].astype(np.int64).tobytes())


def align_texts(column: pa.Array, coders: Encoders, keep_groups: bool = False, window: int = WINDOW) -> list[tuple]:
    """(n_a, n_b, n_groups, digest of the groups, groups, keys and counts of the linked
    id pairs) of every text; zeros and empty values for a null or empty one and for one whose tokens differ from it."""
    spaced = [(" " + t).encode() if t else b"" for t in column.to_pylist()]
    data = np.frombuffer(b"".join(spaced), np.uint8)
    n, offsets = len(spaced), np.concatenate(([0], np.cumsum(list(map(len, spaced))))).astype(np.int64)
    del spaced
    rows = [_Row(keep_groups) for _ in range(n)]
    starts = cuts_of(data, offsets) if coders.cuttable else offsets[:-1][np.diff(offsets) > 0]
    bounds = np.append(starts, len(data))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + window, side="right")) - 1)
        _window(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], T.rows_of(starts[i:j], offsets), rows, coders)
        i = j
    return [r.row() for r in rows]


def _window(data: np.ndarray, bounds: np.ndarray, owner: np.ndarray, rows: list[_Row], coders: Encoders) -> None:
    """Add the segments of a window to their rows."""
    segments = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    coded = segments.dictionary_encode()
    codes, (left, right) = coded.indices.to_numpy().astype(np.int64), coders.encode(coded.dictionary)
    bad = (left.counts == 0)[codes]
    for r in np.unique(owner[bad]):
        rows[r].ok = False
    fine = np.array([rows[r].ok for r in range(owner[0], owner[-1] + 1)], dtype=bool)[owner - owner[0]]
    codes, owner = codes[fine], owner[fine]
    if not len(codes):
        return
    (ids_a, count_a), (ids_b, count_b) = left.of(codes), right.of(codes)
    texts, owner = np.unique(owner, return_inverse=True)
    m = len(texts)
    row_a, row_b = np.repeat(owner, count_a), np.repeat(owner, count_b)
    a, b = intersect(np.cumsum(coders.size_a[ids_a]), np.cumsum(coders.size_b[ids_b]), row_a, row_b, m)
    # groups end at the common ends: first tokens of each, and tokens in front of it on the other side
    ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ends_a[a] = ends_b[b] = 1
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    before_b = np.concatenate(([0], b + 1))
    told = np.empty(len(ids_a) + len(ids_b), np.int64)
    told[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a + ends_a
    told[np.arange(len(ids_b)) + a[group_b] + 1] = 2 * (len(coders.bytes_a) + ids_b) + ends_b
    text = coders.words.take(pa.array(told)).buffers()[2].to_pybytes()
    n_a, n_b = np.bincount(row_a, minlength=m), np.bincount(row_b, minlength=m)
    text_ends = np.cumsum(coders.word_size[told])[np.cumsum(n_a + n_b) - 1]
    groups = np.bincount(row_a[a], minlength=m)
    group_ends = np.cumsum(groups)
    keys = ids_b[b] * len(coders.bytes_a) + ids_a[a]
    at = place = 0
    for k, r in enumerate(texts):
        rows[r].add(int(n_a[k]), int(n_b[k]), int(groups[k]), text[at:text_ends[k]], keys[place:group_ends[k]])
        at, place = text_ends[k], group_ends[k]


def _contents(*paths: str) -> list[bytes]:
    out = []
    for p in paths:
        with open(p, "rb") as f:
            out.append(f.read())
    return out


def align(docs: DataFrame, byte_json: str, piece_model: str, text: str = "text", key: str = "doc_id", keep_groups: bool = False) -> DataFrame:
    """Align both tokenizations of every text.

    byte_json, piece_model: files on the driver; their contents (a vocabulary each)
    are broadcast.  Returns (``key``, n_a, n_b, n_groups, groups_sha256, groups, pair_keys,
    pair_counts): ``groups`` is ``a1,a2|b1;a3|b2,b3`` (empty unless ``keep_groups``; its
    digest needs no such string), ``pair_keys`` the distinct linked id pairs as int64
    ``b * ids of A + a``, ``pair_counts`` how often each is linked in the text.

    A null or empty text and one that either tokenizer does not give back byte by byte
    have zeros and empty values.  Repeated rows are aligned each; an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *_contents(byte_json, piece_model)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, left, right = shared.value
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoders(left, right)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                cols = list(zip(*align_texts(part.column(1), _encoders[name], keep_groups)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    names = ["key", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "pair_keys", "pair_counts"]
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, pair_keys binary, pair_counts binary")
    return found.withColumnRenamed("key", key) if key != "key" else found


def vocabulary_size(byte_json: str) -> int:
    """The factor of ``pair_keys``: one more than the largest id of A."""
    vocabulary = json.loads(_contents(byte_json)[0])
    return 1 + max([*vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary.get("added_tokens") or ())])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): a task's linked pairs, added up as far as memory is meant to go."""
    keys, counts, waiting = [], [], 0

    def told() -> pa.RecordBatch:
        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["pair", "n"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            k, c = (np.frombuffer(T.buffer_of(batch.column(x).slice(i, 1024))[0].tobytes(), np.int64) for x in ("pair_keys", "pair_counts"))
            keys.append(k)
            counts.append(c)
            waiting += len(k)
            if waiting > 2 * TASK_PAIRS:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, waiting = [k], [c], len(k)
                if waiting > TASK_PAIRS:
                    yield told()
                    keys, counts, waiting = [], [], 0
    if waiting:
        yield told()


def pair_counts(aligned: DataFrame, factor: int) -> DataFrame:
    """(b, pair, n): how many links of all texts hold each id pair; ``pair // factor`` is b.

    Tasks add up what they read, so a pair that every text has is one row per task."""
    rows = aligned.select("pair_keys", "pair_counts").mapInArrow(_pairs, "pair long, n long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n")).select(F.floor(F.col("pair") / F.lit(factor)).alias("b"), "pair", "n")


def _slices(counts: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of b with at most ``limit`` pairs each (or a single b): what is read
    here is one row per id of B, a vocabulary's worth."""
    sizes = sorted((r["b"], r["pairs"]) for r in counts.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")).collect())
    out, start, size = [], None, 0
    for b, pairs in sizes:
        if start is not None and size + pairs > limit:
            out.append((start, b - 1))
            start, size = None, 0
        start, size = b if start is None else start, size + pairs
    return out + [(start, sizes[-1][0])] if sizes else out


def _scored(table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what a slice of the corpus counts says to n_best and count_sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                data, offsets = T.buffer_of(part.column("pair_keys"))
                k = np.frombuffer(data.tobytes(), np.int64)
                c = np.frombuffer(T.buffer_of(part.column("pair_counts"))[0].tobytes(), np.int64)
                at = np.searchsorted(pairs, k)
                hit = at < len(pairs)
                hit[hit] = pairs[at[hit]] == k[hit]
                at, c = np.where(hit, at, 0), c * hit
                sums = (T.sums_by_row(c * best[at], offsets // 8), T.sums_by_row(c * n[at], offsets // 8))
                cols = [pa.array(part.column(x).to_numpy() + s) if x in ("n_best", "count_sum") else part.column(x)
                        for x, s in ((x, sums[x == "count_sum"]) for x in part.schema.names)]
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)
    return run


def link_statistics(docs: DataFrame, byte_json: str, piece_model: str, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of both sides are never empty, so a link (two tokens that end together)
    is the end of a group.  Corpus-wide counts are read back by range of B's ids: a
    range has at most ``slice_pairs`` id pairs, is broadcast by itself, and one pass
    over the stored pairs adds it to the documents; two vocabularies bound the number of ranges.
    """
    spark = docs.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/") + f"/aligned-{uuid.uuid4().hex}"
    factor = vocabulary_size(byte_json)
    align(docs, byte_json, piece_model).drop("groups").write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    counts = materialize(pair_counts(stored, factor))
    zero = F.lit(0).cast("long")
    rows = stored.withColumns({"n_best": zero, "count_sum": zero})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranges = _slices(counts, slice_pairs)
    for i, (low, high) in enumerate(ranges):
        part = counts.where(F.col("b").between(low, high)).select("b", "pair", "n").toPandas()  # slice_pairs rows, or those of one b
        order = np.argsort(part["pair"].to_numpy())
        b, pair, n = (part[c].to_numpy()[order].astype(np.int64) for c in ("b", "pair", "n"))
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(b))))
        rows = rows.mapInArrow(_scored(spark.sparkContext.broadcast((pair, n, n == most))), schema)
        if i + 1 < len(ranges):  # one range at a time in the workers' memory
            rows = materialize(rows)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
