"""Suffix, substring, line and near-duplicate operators against brute force."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from codelens.llm import line_dedup, ngram_join, substring_dedup, suffix_dedup, winnow


def same(df, expected):
    assert Counter(tuple(r) for r in df.collect()) == Counter(expected)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_suffix_dedup(which, request):
    docs = request.getfixturevalue(which)
    same(suffix_dedup.repeated_spans(docs), brute.suffix_dedup(pairs(docs)))


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_substring_dedup(which, request):
    docs = request.getfixturevalue(which)
    same(substring_dedup.remove_repeats(docs), brute.substring_dedup(pairs(docs)))


@pytest.mark.parametrize("which,min_lines", [("odd_docs", 2), ("odd_docs", 3), ("small_docs", 1), ("no_docs", 2)])
def test_line_dedup(which, min_lines, request):
    docs = request.getfixturevalue(which)
    got = line_dedup.delete_repeats(docs, min_lines).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    same(got, brute.line_dedup(pairs(docs), min_lines))


def test_kept_texts(odd_docs, odd_rows):
    for r in suffix_dedup.repeated_spans(odd_docs, with_text=True).collect():
        assert brute.sha(bytes(r["kept"])) == r["kept_sha256"]
    for r in substring_dedup.remove_repeats(odd_docs, with_text=True).collect():
        assert brute.sha(r["kept"].encode()) == r["kept_sha256"]
    for r in line_dedup.delete_repeats(odd_docs, with_text=True).collect():
        assert brute.sha(r["kept"].encode()) == r["kept_sha256"]


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_near_groups(which, request):
    docs = request.getfixturevalue(which)
    same(ngram_join.near_duplicate_groups(docs), brute.near_groups(pairs(docs)))


def chain(n=60, words=120):
    """A chain of texts: neighbours are similar, the ends are not; plus strangers."""
    r = random.Random(5)
    text = [f"t{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        out.append((1000 - i, " ".join(text)))
        text = text[3:] + [f"t{r.randrange(10**6)}" for _ in range(3)]
    return out + [(2000 + i, " ".join(f"s{r.randrange(50)}" for _ in range(40))) for i in range(20)]


@pytest.mark.parametrize("block", [4000, 7])
def test_chains_and_blocks(spark, block):
    rows = chain()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.near_duplicate_groups(docs, block), brute.near_groups(rows))


def test_keep_one(odd_docs, odd_rows):
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = brute.near_groups(odd_rows)
    expected = Counter(d for d, n, _c in groups if n == 0)
    expected += Counter({c for _d, n, c in groups if n})
    assert Counter(r["doc_id"] for r in kept.collect()) == expected


def test_hot_anchors_travel_as_windows(spark, monkeypatch):
    """With a low limit every shared anchor counts as hot; results stay the same."""
    shared = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join(f"q{i}_{j}" for j in range(20)) + " " + shared + " " + " ".join(f"r{i}_{j}" for j in range(20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = winnow.shared_keys
    monkeypatch.setattr(winnow, "shared_keys", lambda *a, **k: real(*a, **{**k, "steps": (2, 3)}))
    same(suffix_dedup.repeated_spans(docs), brute.suffix_dedup(rows))
    same(substring_dedup.remove_repeats(docs), brute.substring_dedup(rows))


def test_suffix_sort_orders_suffixes():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400).astype(np.uint8)
    data = np.concatenate((data, data[:150], [0])).astype(np.uint8)
    positions = np.arange(500)
    blocks = positions % 3
    order = suffix_dedup.suffix_sort(data, suffix_dedup.T.prefix_hash(data), positions, blocks, 40)
    keys = [(int(blocks[i]), bytes(data[i:i + 40])) for i in order]
    assert keys == sorted(keys)


def test_packing_round_trips():
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 1 << 32, 1000).astype(np.uint64))
    assert (winnow.unpack32(winnow.pack32(keys)) == keys).all()
    two = r.integers(0, 4, 101).astype(np.uint8)
    assert (winnow._unpack2(winnow._pack2(two), 101) == two).all()
    arrays = [r.integers(0, 3, n).astype(np.int64) for n in (0, 1, 50, 7)]
    bounds, value, offset, length = winnow._unruns(winnow._runs(arrays))
    for i, a in enumerate(arrays):
        runs = slice(bounds[i], bounds[i + 1])
        assert np.repeat(value[runs], length[runs]).tolist() == a.tolist()
        assert offset[runs].tolist() == (np.cumsum(length[runs]) - length[runs]).tolist()


def test_rolling_and_minimum():
    v = np.random.default_rng(2).integers(0, 50, 300).astype(np.uint64)
    for k in (1, 5, 8, 18):
        h = winnow.rolling(v, k)
        groups = {}
        for i in range(len(v) - k + 1):
            groups.setdefault(tuple(v[i:i + k].tolist()), set()).add(int(h[i]))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    for w in (1, 4, 33):
        best = winnow.leftmost_minimum(v << np.uint64(32), w)
        assert [int(v[i:i + w].argmin()) + i for i in range(len(v) - w + 1)] == best.tolist()


def twins(k=10):
    """Two different words of 2^k letters with equal polynomial hashes modulo 2^64 (from k = 10 on)."""
    word = ["ab"[bin(i).count("1") % 2] for i in range(1 << k)]
    return "".join(word), "".join("ba"[c == "b"] for c in word)


def test_long_words_of_equal_polynomial_hash_are_different(spark):
    one, two = twins()
    data = np.frombuffer((one + two).encode(), dtype=np.uint8)
    a, b = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(winnow.T.span_hash(winnow.T.prefix_hash(data), a, b).tolist())) == 1
    assert len(set(winnow.T.span_ids(data, a, b).tolist())) == 2
    assert len({tuple(x) for x in winnow.T.span_digests(data, a, b).tolist()}) == 2
    rows = [(1, f"{one}\nalpha beta\n{one}"), (2, f"{two}\nalpha beta\n{two}"), (3, f"{one}\nalpha beta"),
            (4, f"{one} w x y z"), (5, f"{two} w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(line_dedup.delete_repeats(docs, 2).select("doc_id", "n_lines", "n_removed", "kept_sha256"), brute.line_dedup(rows, 2))
    same(ngram_join.near_duplicate_groups(docs), brute.near_groups(rows))
