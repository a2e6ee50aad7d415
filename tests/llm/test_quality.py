"""Quality classifier and quality rules."""

import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelens.llm import quality_classifier as C
from codelens.llm import quality_rules as R


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return docs, labels, {r[0]: r[1] for r in labels.collect()}


def test_classifier_on_held_out(labelled):
    docs, labels, truth = labelled
    rows = C.score(docs, *C.train(docs, labels)).select("*", C.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) >= 0.97


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("label", F.when(C.held_out(F.col("doc_id")), 1 - F.col("label")).otherwise(F.col("label")))
    a, b = C.train(docs, labels, train_rows=200), C.train(docs, flipped, train_rows=200)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(0)
    weights = r.normal(size=C.SLOTS)
    texts = ["", None, "a", "One two, three!!", "xx " * 50, "äö ß" * 30, "word " * 400000]
    together = C.score_texts(pa.array(texts, pa.string()), weights, 0.25)
    alone = [C.score_texts(pa.array([t], pa.string()), weights, 0.25)[0] for t in texts]
    np.testing.assert_allclose(together, alone, rtol=1e-6)
    assert together[0] == together[1] == C._sigmoid(0.25)


def test_ftrl_separates():
    m, r = C.Ftrl(), np.random.default_rng(4)
    for _ in range(400):
        y = int(r.integers(0, 2))
        slots = np.unique(np.append(r.integers(10, 500, 5), y))
        m.update(np.append(slots, C.SLOTS), np.ones(len(slots) + 1), y)
    w = m.weights()
    assert w[1] > 0 > w[0] and np.abs(w[10:500]).max() < max(w[1], -w[0])


def test_odd_documents(odd_docs, odd_rows, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (4, None), (12, 0), (99, 1)], "doc_id long, label int")
    w, b = C.train(odd_docs, labels)
    assert C.score(odd_docs, w, b).count() == len(odd_rows)
    assert C.score(no_docs, w, b).count() == 0
    w, b = C.train(no_docs, labels)
    assert not w.any() and b == 0.0


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_base_counts(which, request):
    docs = request.getfixturevalue(which)
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in R.verdicts(docs, []).drop("rule").collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = brute.base_counts(r[1])
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.append((r[0] is None, r[0] or 0, *n, failed, not failed))
    assert got == sorted(want)


def test_learned_list(labelled):
    docs, labels, truth = labelled
    rules = R.fit(docs, labels)
    assert rules
    rows = R.verdicts(docs, rules).collect()
    for good, at_least in ((0, 0.95), (1, 0.97)):
        test = [r for r in rows if held(r["doc_id"]) and truth.get(r["doc_id"]) == good and (good == 0 or not r["base_failed"])]
        assert np.mean([r["kept"] == bool(good) for r in test]) >= at_least
    kept = {r["doc_id"] for r in R.keep_good(docs, rules).collect()}
    assert kept == {r["doc_id"] for r in rows if r["kept"]}


def test_covering_finds_a_conjunction():
    r = np.random.default_rng(7)
    x = {f: r.random(3000) for f in R.FEATURES}
    bad = (x["symbols_per_word"] >= 0.6) & (x["upper_share"] <= 0.3)
    rules = R.learn_rules(x, bad)
    out = np.zeros(len(bad), dtype=bool)
    for rule in rules:
        out |= R._covers(rule, x)
    assert (out & bad).sum() >= 0.98 * bad.sum() and (out & ~bad).sum() <= 0.01 * bad.sum()


def test_no_rules_without_labels(no_docs, odd_docs, odd_rows):
    assert R.fit(odd_docs, no_docs.select("doc_id", F.lit(1).alias("label"))) == []
    kept = R.keep_good(odd_docs, [])
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(1 for _d, t in odd_rows if (n := brute.base_counts(t))[0] >= 10 and 100 * n[4] <= 20 * n[0])


def test_the_sample_is_bounded_in_rows(spark):
    """Rows that repeat a sampled id count once per text, and no more than train_rows are fitted."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:30]
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], f"text of {ids[0]}")] * 200 + [(ids[1], f"other text {j}") for j in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, label int")
    assert C._sample(docs, labels, 1000).count() == len(ids) + 100
    first = [tuple(r) for r in C._sample(docs, labels, 20).collect()]
    assert len(first) == 20
    assert sorted(first) == sorted(tuple(r) for r in C._sample(docs.repartition(3), labels, 20).collect())
