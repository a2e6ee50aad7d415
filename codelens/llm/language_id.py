"""Language identification of mixed-language text: script ranges, word scores, Viterbi.

The letters of a word lie in one script; only languages that are written in it
are candidates.  A word's score in a language is the mean log probability of
its character n-grams (1 to 4 characters, with both ends marked) and of the word
as a whole, in hashed slots.  Viterbi over the words of a text, with a penalty
for every change of language, labels spans; the language of the text is the one
with most letters in its spans.

What is learned is counts: n-grams and letters by script, of every learning text
of the corpus, added up per task and then in one grouped sum.  The model is
languages x slots whatever the input; with many languages the slots are fewer,
so that it stays under ``MODEL_BYTES``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.store import materialize

SLOTS = 1 << 16
MODEL_BYTES = 64 << 20
#: Longer runs of letters are cut into words of at most this many characters.
WORD_CHARS = 32
ORDERS = 4
#: Share of a language's letters from which on a script is one of its own.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
PENALTY = 4.0
#: Words between two points where the best paths are put together.
CHUNK = 64
UND = "und"

# First and last code points of the scripts that are told apart (Unicode blocks); other letters form one more.
SCRIPTS = [
    ("Latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
]
N_SCRIPTS = len(SCRIPTS) + 1

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Per code point: ``letter`` (category L), ``inside`` (letter or mark), ``lower``, ``script``."""
    if not _tables:
        every = range(0x110000)
        kinds = [unicodedata.category(chr(i))[0] for i in every]
        _tables["letter"] = np.array([k == "L" for k in kinds])
        _tables["inside"] = np.array([k in "LM" for k in kinds])
        _tables["lower"] = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in every], np.uint32)
        script = np.full(0x110000, len(SCRIPTS), np.uint8)
        for s, (_name, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                script[a:b + 1] = s
        _tables["script"] = script
    return _tables[name]


@dataclass
class Words:
    """Words of a piece of texts: code point spans, rows, scripts, letters, and the distinct ones among them."""
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    scripts: np.ndarray
    letters: np.ndarray
    which: np.ndarray  # index of each word among the distinct ones
    slots: np.ndarray  # slots of the distinct words' n-grams, one word after the other
    sizes: np.ndarray  # n-grams of each distinct word


def words_of(texts: list[str | None]) -> Words:
    """Words: maximal runs of letters and the marks on them, in one script, cut to ``WORD_CHARS``."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t or "") for t in texts]))).astype(np.int64)
    letter, inside = _table("letter")[points], _table("inside")[points]
    script = _table("script")[points]
    # a mark has the script of the letter that it stands on
    at = np.where(letter, np.arange(len(points)), -1)
    at = np.maximum.accumulate(at) if len(at) else at
    script = np.where(letter | (at < 0), script, script[np.maximum(at, 0)])
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[offsets] = True
    first = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1] | (script[1:] != script[:-1]))) if len(points) else inside)
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:] | (script[1:] != script[:-1]), [True])))) if len(points) else starts
    ends = stop + 1
    pieces = -(-(ends - starts) // WORD_CHARS)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, ends = np.repeat(starts, pieces) + nth * WORD_CHARS, np.repeat(ends, pieces)
    ends = np.minimum(starts + WORD_CHARS, ends)
    counts = np.concatenate(([0], np.cumsum(letter)))
    letters = counts[ends] - counts[starts]
    kept = letters > 0  # marks alone are no word
    starts, ends, letters = starts[kept], ends[kept], letters[kept]
    low = _table("lower")[points]
    h = T.span_hash(T.prefix_hash(low), starts, ends)
    _u, at, which = np.unique(h, return_index=True, return_inverse=True)
    slots, sizes = _ngrams(low, starts[at], ends[at], h[at])
    return Words(starts, ends, T.rows_of(starts, offsets), script[starts], letters, which, slots, sizes)


def _ngrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of words, their ends marked, and of the words as a whole."""
    n = ends - starts
    size = n + 2
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(n)), size)
    within = np.arange(int(size.sum())) - first[owner]
    body = (within > 0) & (within <= n[owner])
    marked = np.zeros(len(owner), np.uint64)
    marked[body] = points[starts[owner[body]] + within[body] - 1].astype(np.uint64) + np.uint64(1)
    slots, owners = [T.mix64(whole + np.uint64(7))], [np.arange(len(n))]
    for k in range(1, ORDERS + 1):
        h = T.fold_hash(marked, k)
        same = (owner[k - 1:] == owner[:len(owner) - k + 1]) & (body[:len(body)] if k == 1 else True)
        slots.append(T.mix64(h[same] + np.uint64(k)))
        owners.append(owner[:len(owner) - k + 1][same])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(slots)[order] & np.uint64(SLOTS - 1)).astype(np.int64), np.bincount(owners, minlength=len(n))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _pieces(texts: list[str | None], limit: int = T.PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Rows [i, j) of at most ``limit`` characters together (a longer text by itself)."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i] or "")
        while j < len(texts) and size + len(texts[j] or "") <= limit:
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): a task's n-grams by slot, and behind them its letters by script."""
    found: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, n in found.items():
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(n[slot])],
                                             ["lang", "slot", "n"])
        found.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for i, j in _pieces(texts):
            w = words_of(texts[i:j])
            names, of_row = np.unique(langs[i:j], return_inverse=True)
            for k, lang in enumerate(names.tolist()):
                mine = of_row[w.rows] == k
                times = np.bincount(w.which[mine], minlength=len(w.sizes))
                n = found.setdefault(lang, np.zeros(SLOTS + N_SCRIPTS, np.int64))
                n[:SLOTS] += np.bincount(w.slots, weights=np.repeat(times, w.sizes), minlength=SLOTS).astype(np.int64)
                n[SLOTS:] += np.bincount(w.scripts[mine], weights=w.letters[mine], minlength=N_SCRIPTS).astype(np.int64)
            if len(found) > 64:
                yield from told()
    yield from told()


@dataclass
class Model:
    """Languages in code point order, log probabilities (slots x languages) and candidates (scripts x languages)."""
    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray


def train(docs: DataFrame) -> Model:
    """Count the n-grams of every learning text: rows with a text and a lang, outside the held-out fifth.

    A language that only has texts without letters is not learned; without learning
    rows the model is empty.  Repeated rows count as often as they stand there.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counts = materialize(rows.mapInArrow(_counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    languages = counts.where(F.col("slot") >= SLOTS).select("lang").distinct()
    n_languages = languages.count()
    slots = SLOTS
    while slots * n_languages * 4 > MODEL_BYTES and slots > 256:
        slots //= 2
    if slots * n_languages * 4 > MODEL_BYTES:
        raise ValueError(f"{n_languages} languages make no model of {MODEL_BYTES} bytes")
    folded = F.when(F.col("slot") < SLOTS, F.col("slot") % slots).otherwise(F.col("slot") - SLOTS + slots)
    table = counts.groupBy("lang", folded.cast("int").alias("slot")).agg(F.sum("n").alias("n")).toPandas()  # languages x slots at most
    names = sorted(table["lang"][table["slot"] >= slots].unique().tolist())
    table = table[table["lang"].isin(names)]
    full = np.zeros((slots + N_SCRIPTS, len(names)))
    index = {x: i for i, x in enumerate(names)}
    full[table["slot"].to_numpy(), table["lang"].map(index).to_numpy().astype(np.int64)] = table["n"].to_numpy()
    grams, letters = full[:slots], full[slots:]
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * slots)).astype(np.float32)
    candidates = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    candidates[~candidates.any(axis=1)] = True  # a script that no language is written in narrows nothing
    return Model(names, scores, candidates)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float, chunk: int = CHUNK) -> np.ndarray:
    """Best label of every word: the sum of its scores less ``penalty`` per change is
    largest within each text.  Of equal labels the first stays.

    Texts are cut into chunks; in all of them at once the best path from every label
    before to every label at its end is found, then chunks are put together text by
    text (all texts at once), and the paths are read backwards.
    """
    n, kinds = scores.shape
    out = np.zeros(n, np.int64)
    words = np.diff(offsets)
    per = -(-words // chunk)
    lanes = int(per.sum())
    if not lanes or kinds == 1:
        return out
    owner = np.repeat(np.arange(len(words)), per)
    nth = np.arange(lanes) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][owner] + nth * chunk
    size = np.minimum(chunk, offsets[1:][owner] - start)
    order = np.argsort(-size, kind="stable")
    start, size, first = start[order], size[order], nth[order] == 0
    value = np.full((lanes, kinds, kinds), -np.inf)
    value[:, np.arange(kinds), np.arange(kinds)] = 0.0
    back = np.zeros((chunk, lanes, kinds, kinds), np.uint16 if kinds > 255 else np.uint8)
    own = np.arange(kinds)
    for t in range(int(size[0])):
        k = int(np.searchsorted(-size, -t, side="left"))  # lanes with a word at t
        v = value[:k]
        cost = np.where(first[:k], 0.0, penalty)[:, None] if t == 0 else penalty
        jump, at = v.max(axis=2) - cost, v.argmax(axis=2)
        stay = v >= jump[:, :, None]
        back[t, :k] = np.where(stay, own, at[:, :, None])
        value[:k] = np.where(stay, v, jump[:, :, None]) + scores[start[:k] + t][:, None, :]
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)
    base = np.cumsum(per) - per
    best = np.zeros((len(words), kinds))
    came = np.zeros((lanes, kinds), np.int64)
    for q in range(int(per.max())):
        d = np.flatnonzero(per > q)
        lane = place[base[d] + q]
        total = best[d][:, :, None] + value[lane]
        came[lane] = total.argmax(axis=1)
        best[d] = total.max(axis=1)
    label = best.argmax(axis=1)
    begin, end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for q in reversed(range(int(per.max()))):
        d = np.flatnonzero(per > q)
        lane = place[base[d] + q]
        end[lane] = label[d]
        begin[lane] = label[d] = came[lane, label[d]]
    for t in reversed(range(int(size[0]))):
        k = int(np.searchsorted(-size, -t, side="left"))
        out[start[:k] + t] = end[:k]
        end[:k] = back[t, np.arange(k), begin[:k], end[:k]]
    return out


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Mean log probability of every word in every language; languages that do not use its script are out."""
    grams = model.scores[w.slots & (len(model.scores) - 1)].astype(np.float64)
    first = np.cumsum(w.sizes) - w.sizes  # every word has n-grams; sums do not depend on the words around it
    mean = (np.add.reduceat(grams, first, axis=0) if len(first) else grams) / w.sizes[:, None]
    # a long word says more than a short one: the mean counts once per character
    scores = mean[w.which] * np.minimum(w.ends - w.starts, WORD_CHARS)[:, None]
    return np.where(model.candidates[w.scripts], scores, -1e6)


def label_texts(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
    """(language, its share of the letters, spans (start, end, language) in characters) of every text."""
    langs, shares, spans = [], [], []
    limit = max(1 << 14, T.PIECE_BYTES * 16 // max(16, len(model.languages) ** 2))  # the paths kept are languages^2 per word
    for i, j in _pieces(texts, limit):
        w = words_of(texts[i:j])
        offsets = T.counts_to_offsets(w.rows, j - i)
        label = viterbi(word_scores(w, model), offsets, penalty) if model.languages else np.zeros(len(w.rows), np.int64)
        base = np.concatenate(([0], np.cumsum([len(t or "") for t in texts[i:j]])))
        for r in range(j - i):
            a, b = offsets[r], offsets[r + 1]
            if a == b or not model.languages:
                langs.append(UND)
                shares.append(0.0)
                spans.append([])
                continue
            letters = np.bincount(label[a:b], weights=w.letters[a:b], minlength=len(model.languages))
            best = int(letters.argmax())
            langs.append(model.languages[best])
            shares.append(float(letters[best] / letters.sum()))
            cut = np.flatnonzero(np.concatenate(([True], label[a + 1:b] != label[a:b - 1])))
            last = np.append(cut[1:], b - a) - 1
            spans.append([(int(s), int(e), model.languages[x]) for s, e, x in
                          zip(w.starts[a + cut] - base[r], w.ends[a + last] - base[r], label[a + cut])])
    return langs, shares, spans


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; only the text is read.

    ``lang_pred`` is the language with most letters (of equal ones the first in code
    point order), ``und`` for a null text, one without a letter, or an empty model;
    ``score`` is its share of the letters (``und``: 0); ``spans`` are (start, end, lang) in
    characters, from the first to the last word of a run (left out unless ``with_spans``).
    Repeated rows are labelled alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                langs, shares, spans = label_texts(part.column(1).to_pylist(), shared.value, penalty)
                columns = [part.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
                if with_spans:
                    columns.append(pa.array([[{"start": s, "end": e, "lang": x} for s, e, x in r] for r in spans], span))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
