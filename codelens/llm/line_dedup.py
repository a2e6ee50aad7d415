"""Line dedup: later copies of repeated runs of lines are deleted.

Documents are sequences of line ids (128-bit BLAKE2b digests of their non-blank lines, so
equal ids stand for equal lines).
Suffixes of all sequences are ranked by distributed prefix doubling: a suffix's
rank counts the suffixes that sort before it by their first ``depth`` lines, and
the ranks at depth ``d`` and ``d`` lines further on give the ranks at depth
``2 d``: count the pairs, add up the counts in order within the old rank, join
back.  (The last step overlaps if ``min_lines`` is no power of two.)  Suffixes
that have become unique drop out at once, so each round shuffles only what still
repeats.

Suffixes with equal ranks at depth ``min_lines`` form an interval of the suffix
array whose longest common prefix is ``min_lines`` or more; those that begin with a long line
already do at depth 1.  Every member but the
first (by document id, then position) starts a later copy; consecutive starts
whose originals are consecutive too are one maximal repeated run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.store import materialize
from codelens.llm.winnow import NO_ID, Chunk, TextStore, key_buckets, key_levels, shared_keys

PIECE = 1 << 18
RANK_BITS = 12


def line_ids(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half, words, offsets by text) of the ids of all non-blank lines."""
    one, two, counts, sizes = [], [], [], []
    for _first, data, offsets in chunk.pieces(PIECE):
        a, b = T.runs_of(data != 10, offsets)
        words, _ends = T.words_of(data, offsets)
        n = np.searchsorted(words, b) - np.searchsorted(words, a)
        a, b, n = a[n > 0], b[n > 0], n[n > 0]
        counts.append(n)
        halves = T.span_digests(data, a, b)
        one.append(halves[:, 0])
        two.append(halves[:, 1])
        sizes.append(np.bincount(T.rows_of(a, offsets), minlength=len(offsets) - 1))
    if not one:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(one), np.concatenate(two), np.concatenate(counts), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)


def first_ranks(lines: DataFrame) -> DataFrame:
    """(node, pos, least, long, a, b) -> (node, pos, least, long, rank) by the order of the line
    ids, without lines that occur once.  The running count is taken per block of
    leading bits, with the blocks' totals added up in a table of 4096 rows."""
    block: Column = F.shiftrightunsigned("a", 64 - RANK_BITS).cast("int")
    classes = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("block", block)
    blocks = classes.groupBy("block").agg(F.sum("n").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("base"))
    within = Window.partitionBy("block").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (classes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0).cast("long"))).join(F.broadcast(blocks), "block")  # 4096 rows at most
              .select("a", "b", (F.col("base") + F.col("inner")).alias("rank")))
    return lines.join(ranked, ["a", "b"]).select("node", "pos", "least", "long", "rank")


def doubled(ranks: DataFrame, further: int) -> DataFrame:
    """Ranks of the prefixes that are ``further`` lines longer, for suffixes that still repeat."""
    later = ranks.select("node", (F.col("pos") - further).alias("pos"), F.col("rank").alias("then"))
    pairs = ranks.join(later, ["node", "pos"])
    counted = pairs.groupBy("rank", "then").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("rank").orderBy("then").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("next", F.col("rank") + F.coalesce(F.sum("n").over(within), F.lit(0).cast("long"))).where("n > 1")
    return pairs.join(counted.drop("n"), ["rank", "then"]).select("node", "pos", "least", "long", F.col("next").alias("rank"))


def repeated_starts(lines: DataFrame, min_lines: int) -> DataFrame:
    """(node, pos, lines, from_node, from_pos): starts of later copies of ``min_lines``
    lines, and of one line where it is long, and their originals."""
    ranks, depth = materialize(first_ranks(lines)), 1
    single = _later(ranks.where("long"), 1) if min_lines > 1 else None
    while depth < min_lines:
        further = min(depth, min_lines - depth)
        ranks = materialize(doubled(ranks, further))
        depth += further
    found = _later(ranks, min_lines)
    return found if single is None else found.unionByName(single)


def _later(ranks: DataFrame, lines: int) -> DataFrame:
    me = F.struct("least", "node", "pos")
    # written out, so that the join is one of its own, whose hot ranks Spark can split
    original = materialize(ranks.groupBy("rank").agg(F.min(me).alias("original")))
    return (ranks.join(original, "rank").where(me != F.col("original"))
            .select("node", "pos", F.lit(lines).alias("lines"), F.col("original.node").alias("from_node"), F.col("original.pos").alias("from_pos")))


def delete_repeats(docs: DataFrame, min_lines: int = 2, with_text: bool = False, long_words: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (non-blank), n_removed, n_runs (maximal
    repeated runs that were deleted), kept_sha256 and, on request, ``kept`` (the
    other lines, blank ones included, joined by a line feed).

    Lines are parts between line feeds and compare byte by byte; blank ones (only
    ASCII white space) are no part of a sequence and always stay.  A single line
    of ``long_words`` words or more is a run by itself, whatever stands around it.  A run may
    overlap its own copy in a document.  A text that a smaller doc_id also has is
    one run and goes as a whole, however few lines it has; equal ids do not
    remove each other; a null id comes last.  Null texts have no lines.  Extra
    columns are not read; an empty table gives an empty result.
    """
    store = TextStore.build(docs)
    buckets = key_buckets(store.chunks)

    def keys_of(chunk: Chunk) -> tuple[np.ndarray, bytes | None]:
        return line_ids(chunk)[0], None

    masks = materialize(shared_keys(store, keys_of, None, buckets))

    def emit(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk.load(table)
        a, b, words, at = line_ids(chunk)
        u, inverse, _n = T.distinct(a)
        again = np.flatnonzero(key_levels(u, dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist())),
                                          buckets)[inverse]) if len(u) else np.zeros(0, np.int64)
        row = np.searchsorted(at, again, side="right") - 1
        return pa.table({"node": pa.array((np.int64(key[0].as_py()) << np.int64(32)) + row), "pos": pa.array((again - at[row]).astype(np.int64)),
                         "least": pa.array(chunk.ids[row] if len(row) else np.zeros(0, np.int64)), "long": pa.array(words[again] >= long_words), "a": pa.array(a[again].view(np.int64)),
                         "b": pa.array(b[again].view(np.int64))})

    chunks = store.table.groupBy("chunk")
    lines = materialize(chunks.cogroup(masks.groupBy("chunk")).applyInArrow(emit, "node long, pos long, least long, long boolean, a long, b long"))
    starts = repeated_starts(lines, min_lines).withColumn("chunk", F.shiftright("node", 32).cast("int"))

    def finish(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk.load(table)
        base = key[0].as_py() << 32
        copies: list[list] = [[] for _ in chunk.texts]
        for node, *copy in zip(*(found.column(c).to_pylist() for c in ("node", "pos", "lines", "from_node", "from_pos"))):
            copies[node - base].append(tuple(copy))
        n_lines, removed, runs, kept = [], [], [], []
        for text, mine in zip(chunk.texts, copies):
            lines, numbers = text.split(b"\n"), []
            for i, line in enumerate(lines):
                if line.split():
                    numbers.append(i)
            mine.sort()
            gone: set[int] = set()
            starts = set()
            for pos, length, node, at in mine:
                gone.update(range(pos, pos + length))
                starts.add((pos, node, at))
            # a start goes on where the line before is a start whose original is the line before this one's
            n = sum((pos - 1, node, at - 1) not in starts for pos, node, at in starts)
            drop = {numbers[p] for p in gone}
            n_lines.append(len(numbers))
            removed.append(len(drop))
            runs.append(n)
            kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop))
        columns = {"h1": pa.array(chunk.h1), "h2": pa.array(chunk.h2), "least": pa.array(chunk.ids),
                   "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_runs": pa.array(runs, pa.int64()),
                   "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_text:
            columns["kept"] = pa.array([k.decode("utf-8") for k in kept], pa.string())
        blank = [b"\n".join(x for x in t.split(b"\n") if not x.split()) for t in chunk.texts]
        columns["blank_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in blank], pa.string())
        if with_text:
            columns["blank"] = pa.array([x.decode("utf-8") for x in blank], pa.string())
        return pa.table(columns)

    schema = ("h1 long, h2 long, least long, n_lines long, n_removed long, n_runs long, kept_sha256 string"
              + (", kept string" if with_text else "") + ", blank_sha256 string" + (", blank string" if with_text else ""))
    done = chunks.cogroup(starts.groupBy("chunk")).applyInArrow(finish, schema)
    joined = store.rows.join(done, ["h1", "h2"], "left")
    empty = F.col("least").isNull()
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least")) & (F.col("n_lines") > 0)
    pick = lambda own, whole, none: F.when(empty, none).when(copy, whole).otherwise(own)
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), pick(F.col("n_removed"), F.col("n_lines"), zero).alias("n_removed"),
        pick(F.col("n_runs"), F.lit(1).cast("long"), zero).alias("n_runs"),
        pick(F.col("kept_sha256"), F.col("blank_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
        *([pick(F.col("kept"), F.col("blank"), F.lit("")).alias("kept")] if with_text else []))
