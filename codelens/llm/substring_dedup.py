"""Substring dedup with repeated-phrase automata.

A word goes if it lies in a window of 35 words whose word sequence starts
anywhere else too.  Stretches that may recur meet in buckets by their winnowing
anchors (see ``winnow``).  Each bucket is a shard: it confirms the recurring
passages by comparing their words, compiles them into one Aho-Corasick automaton
(pyahocorasick, with every distinct word as one character, so a match is a match
of whole words), and streams the stretches of all documents that reached it
through the automaton to locate every occurrence.  A document without an anchor
in a shard cannot hold one of its passages, which is why it need not be streamed there.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.winnow import Chunk, Scheme, Stretches, TextStore, Windows, repeated_windows

#: Words of an anchor.
K = 12
#: Words a shard compiles at once; below the number of characters that words can be mapped to.
BATCH_WORDS = 1_000_000


def _spell(texts: list[bytes]) -> list[str]:
    """Texts as strings with one character per word; equal words, equal characters."""
    letters: dict[bytes, int] = {}
    out = []
    for t in texts:
        codes = np.array([letters.setdefault(w, len(letters)) for w in t.split(b" ")], dtype=np.uint32)
        codes += np.where(codes >= 0xD7FF, 0x801, 1).astype(np.uint32)  # no zero, no surrogates
        out.append(codes.tobytes().decode("utf-32-le"))
    return out


def _passages(spelled: list[str], anchor: np.ndarray, seen: np.ndarray, length: int) -> set[str]:
    """The confirmed recurring passages: stretches that occur twice, and in the
    others the maximal runs of windows that also stand in another stretch."""
    out = {t for t, n in zip(spelled, seen.tolist()) if n > 1}
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi - lo < 2:
            continue
        members = [spelled[i] for i in order[lo:hi]]
        times = Counter(t[j:j + length] for t in members for j in range(len(t) - length + 1))
        for t, i in zip(members, order[lo:hi]):
            if seen[i] > 1:
                continue
            begin = None
            for j in range(len(t) - length + 2):
                again = j <= len(t) - length and times[t[j:j + length]] > 1
                if again and begin is None:
                    begin = j
                elif not again and begin is not None:
                    out.add(t[begin:j - 1 + length])
                    begin = None
    return out


def locate(s: Stretches, scheme: Scheme) -> list[np.ndarray]:
    """For every window of every stretch: 1 if its words start anywhere else too."""
    out = [np.zeros(n, dtype=np.int64) for n in s.count.tolist()]
    order = np.argsort(s.anchor, kind="stable")
    size = s.count[order] + scheme.length - 1
    a = s.anchor[order]
    # whole anchors per batch
    last = np.flatnonzero(np.concatenate((a[1:] != a[:-1], [True]))) if len(a) else np.zeros(0, np.int64)
    total = np.cumsum(size)
    begin = 0
    while begin < len(order):
        limit = (total[begin - 1] if begin else 0) + BATCH_WORDS
        fit = last[(last >= begin) & (total[last] <= limit)]
        end = int(fit[-1] if len(fit) else last[last >= begin][0]) + 1
        batch = order[begin:end]
        begin = end
        spelled = _spell([s.texts[i] for i in batch])
        passages = _passages(spelled, s.anchor[batch], s.seen[batch], scheme.length)
        if not passages:
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in passages:
            automaton.add_word(p)
        automaton.make_automaton()
        for i, text in zip(batch.tolist(), spelled):
            values = out[i]
            for at, n in automaton.iter(text):
                values[at - n + 1:at - scheme.length + 2] = 1
    return out


def remove_repeats(docs: DataFrame, length: int = 35, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, on request,
    ``kept`` (the kept words joined by one space).

    Words are runs without ASCII white space.  Repeats inside a document count.
    Equal texts with ``length`` words or more go in all their copies, rows with
    the same id included.  Null texts have no words.  Extra columns are not read.
    """
    scheme = Scheme(length, min(K, length), words=True)
    store = TextStore.build(docs)

    def finish(chunk: Chunk, windows: Windows) -> pa.Table:
        split = [t.split() for t in chunk.texts]
        row, low, high = windows.spans(windows.value > 0, np.array([len(w) for w in split], np.int64), length)
        spans: list[list[tuple[int, int]]] = [[] for _ in split]
        for r, a, b in zip(row.tolist(), low.tolist(), high.tolist()):
            spans[r].append((a, b))
        counts, removed, kept = [], [], []
        for words, cut in zip(split, spans):
            rest, at = [], 0
            for a, b in cut:
                rest += words[at:a]
                at = b
            rest += words[at:]
            counts.append(len(words))
            removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest))
        columns = {"h1": pa.array(chunk.h1), "h2": pa.array(chunk.h2), "n_words": pa.array(counts, pa.int64()),
                   "n_removed": pa.array(removed, pa.int64()),
                   "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_text:
            columns["kept"] = pa.array([k.decode("utf-8", "surrogateescape") for k in kept], pa.string())
        return pa.table(columns)

    schema = "h1 long, h2 long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    found = repeated_windows(store, scheme, locate, finish, schema)
    copies = store.rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    found = copies.join(found, ["h1", "h2"], "left")
    joined = store.rows.join(found, ["h1", "h2"])
    words = F.coalesce("n_words", F.lit(0)).cast("long")
    whole = (F.col("copies") > 1) & (words >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id", words.alias("n_words"),
        F.when(whole, words).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole | F.col("n_words").isNull(), nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(whole | F.col("n_words").isNull(), "").otherwise(F.col("kept")).alias("kept")] if with_text else []))
