"""Quality rules: a learned decision list over text statistics.

Sequential covering in the manner of RIPPER: the statistics of labelled documents
are split into a growing and a pruning part; a rule is grown by adding the
threshold condition with the best information gain until it covers no good
document of the growing part, then trailing conditions are pruned as long as the
pruning part does not get worse; the documents it covers are set aside and the
next rule is learned.  A rule is kept only if it is precise on the pruning part.
The list becomes an ordered ``CASE WHEN`` over the statistics columns, so what
runs on the corpus is one readable Spark expression.

Statistics are computed for whole texts; the labelled sample that the list is
learned from is bounded by ``train_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.quality_classifier import held_out
from codelens.llm.store import fresh

WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_same_words")
STATS = BASE + EXTRA
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each sorted element, group sizes) of equal (row, key);
    the row is hashed into the 64-bit key, so one plain sort does."""
    keys = T.mix64(keys + T.mix64(rows.astype(np.uint64)))
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(k)))


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every text of a piece."""
    n = len(offsets) - 1
    prefix = T.prefix_hash(data)
    starts, ends = T.words_of(data, offsets)
    rows = T.rows_of(starts, offsets)
    at = T.counts_to_offsets(rows, n)
    out = {"n_words": np.diff(at)}
    out["word_chars"] = T.sums_by_row(~T.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = T.sums_by_row(_SYMBOL[data], offsets)
    out["n_upper"] = T.sums_by_row((data >= 65) & (data <= 90), offsets)
    out["n_digits"] = T.sums_by_row((data >= 48) & (data <= 57), offsets)
    words = T.span_hash(prefix, starts, ends)

    line_start, line_end = T.runs_of(data != 10, offsets)
    line_row = T.rows_of(line_start, offsets)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    order, _group, sizes = _distinct(T.span_hash(prefix, line_start, line_end), line_row)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[order][first], minlength=n)

    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out["n_same_words"] = T.sums_by_row(same, at)

    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= WINDOW:
        ok = np.flatnonzero(rows[WINDOW - 1:] == rows[:len(rows) - WINDOW + 1])
        order, group, sizes = _distinct(T.fold_hash(words, WINDOW)[ok], rows[ok])
        twice = ok[order[sizes[group] >= 2]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = T.sums_by_row(np.cumsum(covered)[:len(words)] > 0, at)
    return out


def with_stats(docs: DataFrame, keep: list[str] | None = None, prefix: str = "_q_") -> DataFrame:
    """``docs`` (or its columns ``keep``) with one column per statistic, named
    ``<prefix><statistic>``; a null text counts as empty.  Streams Arrow batches."""
    keep = docs.columns if keep is None else keep
    names = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffer_of(batch.column(names.index("text")))
            found = [text_stats(part, at) for _i, _j, part, at in T.pieces(data, offsets)]
            stats = [pa.array(np.concatenate([f[s] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)) for s in STATS]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in keep] + stats,
                                             list(keep) + [prefix + s for s in STATS])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*names).mapInArrow(run, kinds + "".join(f", {prefix}{s} long" for s in STATS))


#: Threshold features: name -> (numerator, denominator) statistics, as shares or means.
#: Shares that fall with a text's length alone (such as distinct words) are left out:
#: a rule on them would reject long clean documents.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "mean_word_length": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "same_word_share": ("n_same_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str) -> Column:
        top, bottom = FEATURES[self.feature]
        value = (F.col(prefix + top).cast("double")
                 / F.greatest(F.col(prefix + bottom), F.lit(1)).cast("double"))
        return value >= self.threshold if self.above else value <= self.threshold

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def feature_values(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: stats[a].astype(float) / np.maximum(stats[b], 1).astype(float) for f, (a, b) in FEATURES.items()}


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The threshold with the largest FOIL gain; midpoints between values, so that
    a cut lies as far from both classes as the sample allows."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return None
    base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, b = v[order], bad[order]
        cuts = np.flatnonzero(s[1:] > s[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(b)[cuts - 1]
        for above, p, n in ((True, p0 - below, n0 - (cuts - below)), (False, below, cuts - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = gain[i], Condition(name, above, float((s[cuts[i] - 1] + s[cuts[i]]) / 2))
    return found


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, min_cover: int = 3,
                min_precision: float = 0.97) -> list[Rule]:
    """Ordered rejecting rules.  Every third document belongs to the pruning part."""
    rules: list[Rule] = []
    live = np.ones(len(bad), dtype=bool)
    prune_part = np.arange(len(bad)) % 3 == 2
    take = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
    while len(rules) < max_rules and bad[live].sum() >= min_cover:
        gx, gb = take(live & ~prune_part)
        rule: Rule = ()
        while len(rule) < 4:
            inside = _covers(rule, gx) if rule else np.ones(len(gb), dtype=bool)
            c = _best_condition({k: v[inside] for k, v in gx.items()}, gb[inside])
            if c is None:
                break
            rule += (c,)
        if not rule:
            break
        px, pb = take(live & prune_part)

        def worth(r: Rule) -> float:
            m = _covers(r, px)
            p, n = (pb & m).sum(), (~pb & m).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(rule, x) & live
        hits, wrong = (bad & covered).sum(), (~bad & covered).sum()
        if hits < min_cover or hits < min_precision * (hits + wrong):
            break
        rules.append(rule)
        live &= ~covered
    return rules


def rejected(rules: list[Rule], prefix: str = "_q_") -> Column:
    """The list as one ordered conditional: number of the first rule that fires, else null."""
    out = None
    for i, rule in enumerate(rules):
        cond = rule[0].column(prefix)
        for c in rule[1:]:
            cond = cond & c.column(prefix)
        out = F.when(cond, F.lit(i + 1)) if out is None else out.when(cond, F.lit(i + 1))
    return F.lit(None).cast("int") if out is None else out


def base_failed(prefix: str = "_q_") -> Column:
    """Fewer than 10 words, or more than a fifth of the words in repeated 5-word windows."""
    return (F.col(prefix + "n_words") < 10) | (F.col(prefix + "n_repeat_words") * 100 > F.col(prefix + "n_words") * 20)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, **options: float) -> list[Rule]:
    """Learn the list from at most ``train_rows`` labelled documents outside the
    held-out fifth (those with the smallest id hash).  Only their statistics, nine
    numbers a document, reach the driver.  labels: (doc_id, label), 1 for good;
    nulls are left out.  Documents that fail the base rules teach nothing."""
    wanted = (labels.select(F.col("doc_id").alias("k"), F.col("label").cast("int").alias("label"))
              .where(F.col("k").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("k"))).distinct()
              .orderBy(F.xxhash64("k"), "k", "label").limit(train_rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("k"))  # train_rows rows at most
    rows = (with_stats(sample.select("doc_id", "label", "text"), ["doc_id", "label"]).where(~base_failed())
            .orderBy(F.xxhash64("doc_id"), "doc_id", "label", *["_q_" + s for s in STATS]).limit(train_rows).collect())
    if not rows:
        return []
    stats = {s: np.array([r["_q_" + s] for r in rows], dtype=np.int64) for s in STATS}
    return learn_rules(feature_values(stats), np.array([r["label"] == 0 for r in rows]), **options)


def verdicts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row: doc_id, the five base counts, base_failed, kept, and ``rule`` (number
    of the learned rule that rejects it, null if none).  Null texts have no words
    and fail the base rules; repeated rows are judged alike."""
    judged = with_stats(docs, ["doc_id"]).withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return judged.select("doc_id", *[F.col("_q_" + s).alias(s) for s in BASE], "base_failed",
                         (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base rules and the list let pass, columns unchanged."""
    prefix = fresh(docs, "_q_")
    judged = with_stats(docs, prefix=prefix)
    return judged.where(~base_failed(prefix) & rejected(rules, prefix).isNull()).select(*docs.columns)
