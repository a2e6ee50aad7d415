"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot
products.

Tokens are maximal runs of word characters or of symbols; every token also has a
shape (symbol, digits, upper case, capitalised, lower case, and whether it
repeats the token before it).  Features are hashed token unigrams and bigrams
and shape unigrams, bigrams and trigrams, in 2^20 slots; a feature's value is
its count over the number of features.  Only the text is read: labels, lang,
source and doc_id never enter a score.

Training fits a bounded, documented sample: the ``train_rows`` labelled documents
with the smallest hash of their id, repeated rows counted once.  The model is 2^20 weights whatever the
input, which is what gets broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T

SLOTS = 1 << 20
#: Features come as shares of a document's features times this.
SCALE = 32.0

# byte classes: 0 white space, 1 symbol, 2 digit, 3 upper case, 4 other word characters
_CLASS = np.full(256, 1, dtype=np.uint8)
_CLASS[T.SPACE] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 4
_KINDS = 7


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, row offsets) of the hashed features of a piece, sorted by row."""
    kind = _CLASS[data]
    s1, e1 = T.runs_of(kind >= 2, offsets)
    s2, e2 = T.runs_of(kind == 1, offsets)
    starts = np.concatenate((s1, s2))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate((e1, e2))[order]
    n = len(offsets) - 1
    rows = T.rows_of(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    h = T.span_hash(T.prefix_hash(data), starts, ends)
    upper = np.concatenate(([0], np.cumsum(kind == 3)))
    digit = np.concatenate(([0], np.cumsum(kind == 2)))
    length, ups = ends - starts, upper[ends] - upper[starts]
    shape = np.where(kind[starts] == 1, 1, np.where(digit[ends] > digit[starts], 2, np.where(
        (ups >= 2) & (2 * ups > length), 3, np.where(kind[starts] == 3, 4, np.where(length > 12, 5, 6))))).astype(np.uint64)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    shape = shape + np.uint64(_KINDS + 1) * same.astype(np.uint64)
    parts, owners = [h, T.mix64(shape + np.uint64(1 << 32))], [rows, rows]
    for k, values in ((2, h), (2, shape), (3, shape)):
        if len(values) >= k:
            together = rows[k - 1:] == rows[:len(rows) - k + 1]
            parts.append(T.mix64(T.fold_hash(values, k)[together] + np.uint64(k)))
            owners.append(rows[:len(rows) - k + 1][together])
    slots = (np.concatenate(parts) & np.uint64(SLOTS - 1)).astype(np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return slots[order], T.counts_to_offsets(owner, n)


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def score_texts(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of every text; an empty or null text scores by the bias alone."""
    data, offsets = T.buffer_of(column)
    out = np.empty(len(offsets) - 1, dtype=np.float64)
    for i, j, part, at in T.pieces(data, offsets):
        slots, ends = _features(part, at)
        c = np.concatenate(([0.0], np.cumsum(weights[slots])))
        count = np.maximum(np.diff(ends), 1)
        out[i:j] = _sigmoid(bias + SCALE * (c[ends[1:]] - c[ends[:-1]]) / count)
    return out


class Ftrl:
    """FTRL-proximal logistic regression (McMahan et al., "Ad Click Prediction")."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        """``slots`` are distinct; slot ``SLOTS`` is the bias."""
        w = self.weights(slots)
        g = (float(_sigmoid(float(w @ values))) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, label, hash, text) -> (rank, label, hash, slots, values): distinct features of each document."""
    for batch in batches:
        data, offsets = T.buffer_of(batch.column("text"))
        found, shares = [], []
        for _i, _j, part, at in T.pieces(data, offsets):
            slots, ends = _features(part, at)
            for a, b in zip(ends[:-1], ends[1:]):
                u, c = np.unique(slots[a:b], return_counts=True)
                found.append(u.astype(np.int32).tobytes())
                shares.append((SCALE * c / max(b - a, 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label"), batch.column("hash"), pa.array(found, pa.binary()),
                                          pa.array(shares, pa.binary())], ["rank", "label", "hash", "slots", "values"])


def _fit(batches: Iterator[pa.RecordBatch], epochs: int, **ftrl: float) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1], r[2]))
    model = Ftrl(**ftrl)
    last = np.array([SLOTS])
    for _ in range(epochs):
        for _rank, label, slots, values in rows:
            at = np.concatenate((np.frombuffer(slots, np.int32), last))
            model.update(at, np.concatenate((np.frombuffer(values, np.float32), [1.0])), float(label))
    w = model.weights()
    kept = np.flatnonzero(w[:SLOTS])
    yield pa.RecordBatch.from_arrays([pa.array([float(w[SLOTS])]), pa.array([kept.astype(np.int32).tobytes()], pa.binary()),
                                      pa.array([w[kept].astype(np.float64).tobytes()], pa.binary())], ["bias", "slots", "weights"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(rank, label, slots, values) of at most ``train_rows`` rows: a document counts
    once per label and text, however often it is repeated, and the smallest hashes of id, then label and text, come first."""
    wanted = (labels.select(F.col("doc_id").alias("k"), F.col("label").cast("int").alias("label"))
              .where(F.col("k").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("k"))).distinct()
              .withColumn("rank", F.xxhash64("k")).orderBy("rank", "k", "label").limit(train_rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("k"))  # train_rows labels at most
    once = sample.withColumn("hash", F.sha2("text", 256)).dropDuplicates(["k", "label", "hash"])
    rows = (once.select("rank", "label", "hash", "text")
            .mapInArrow(_rows, "rank long, label int, hash string, slots binary, values binary"))
    return rows.orderBy("rank", "label", "hash").limit(train_rows).select("rank", "label", "slots", "values")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 10_000, epochs: int = 3, **ftrl: float) -> tuple[np.ndarray, float]:
    """Fit on at most ``train_rows`` labelled documents outside the held-out fifth.

    labels: (doc_id, label) with label 0 or 1; rows with a null in either column
    are left out, repeated ones count once per distinct label.  Features are
    extracted by all executors; one task runs the updates over the bounded
    sample and returns the weights.  Without any label the model is all zero.
    """
    spark = docs.sparkSession
    rows = _sample(docs, labels, train_rows)
    fitted = (rows.repartition(1).mapInArrow(lambda b: _fit(b, epochs, **ftrl), "bias double, slots binary, weights binary")).collect()
    weights = np.zeros(SLOTS)
    if not fitted:
        return weights, 0.0
    weights[np.frombuffer(fitted[0]["slots"], np.int32)] = np.frombuffer(fitted[0]["weights"], np.float64)
    return weights, fitted[0]["bias"]


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row.  Null and empty texts get the
    score of the bias; repeated rows are scored alike; other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2^20 doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), model.value, bias))],
                                             ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
