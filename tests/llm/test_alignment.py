"""Cross-tokenizer alignment against whole-text tokenizing and a plain two-pointer merge."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelens.llm import token_alignment as A

BYTE, PIECE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coders():
    return A.Encoders(*A._contents(BYTE, PIECE))


def plain(text, coders):
    """(ids A, ids B, groups) from whole texts and one pass over both lists; None without tokens."""
    if not text:
        return None
    a, b = coders.a.encode(" " + text, add_special_tokens=False).ids, coders.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(coders.bytes_a[i] for i in a) != whole or b"".join(coders.bytes_b[i] for i in b) != whole:
        return None
    groups, left, right, i, j, x, y = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(coders.bytes_a[a[i]])
            left.append(a[i])
            i += 1
        else:
            y += len(coders.bytes_b[b[j]])
            right.append(b[j])
            j += 1
        if x == y:
            groups.append((left, right))
            left, right = [], []
    return a, b, groups


def told(groups):
    return ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)


ODD = ["", None, " ", "  ", "a", "a b", " a", "a ", "a  b", "a\n b", "a \n b", "don't I'll  we 've x", "é à ï ö ñ",
       "a b   c　d", "x  y", "é é", "▁x y", "x ▁", "<s> </s> <unk> <0x41>", "<|endoftext|> a <|endoftext|>", "\x00 \x01 a",
       "日本語 の テキスト", "漢字　漢字", "😀 😀😀", "é éx", "ﬁ ﬂ", "1 2 33 4444", "... !!! ?", "\u0085 a \u0085b", "​ a", "x" * 3000,
       "ab " * 500, "\t a\t b", "a   b", "Ａ Ｂ", "the  the   the", "▁", "no▁ way", "l'été à l'œuvre", "ÃƒÂ© Ã‚"]


def check(texts, coders, **more):
    found = A.align_texts(pa.array(texts, pa.string()), coders, keep_groups=True, **more)
    for text, (n_a, n_b, n_groups, sha, groups, keys, counts) in zip(texts, found):
        want = plain(text, coders)
        if want is None:
            assert (n_a, n_b, n_groups, sha, groups, keys, counts) == (0, 0, 0, "", "", b"", b""), text
            continue
        assert (n_a, n_b, n_groups) == (len(want[0]), len(want[1]), len(want[2])), text
        assert groups == told(want[2]) and sha == hashlib.sha256(groups.encode()).hexdigest(), text
        links = Counter(h[-1] * len(coders.bytes_a) + g[-1] for g, h in want[2])
        assert dict(zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(counts, np.int64).tolist())) == links


def test_odd_texts(coders):
    assert coders.cuttable
    check(ODD, coders)
    check(ODD, coders, window=1)  # every segment by itself


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t  　\u0085éàñß'▁.,1aAbzé漢😀<>s|́"), max_size=40), max_size=4))
def test_random_texts(texts):
    check(texts, _coders())


_kept = []


def _coders():
    if not _kept:
        _kept.append(A.Encoders(*A._contents(BYTE, PIECE)))
    return _kept[0]


def test_tables_texts(spark, coders):
    check([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()], coders)


def test_without_ranks(coders, monkeypatch):
    assert coders.fast is not None
    monkeypatch.setattr(coders, "fast", None)
    check(ODD, coders)
    monkeypatch.setattr(coders, "cuttable", False)
    check(ODD, coders)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), unique=True), st.lists(st.integers(0, 300), unique=True), st.integers(-5, 400))
def test_gallop_is_a_lower_bound(a, b, start):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    at = A.gallop(a, b, np.full(len(a), start))
    assert at.tolist() == np.searchsorted(b, a, side="left").tolist()
    i, j = A.intersect(a, b, np.zeros(len(a), int), np.zeros(len(b), int), 1)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_overlaps():
    a, b = np.array([2, 5, 9, 10]), np.array([1, 2, 3, 6, 7, 9, 10])
    first, end = A.overlaps(a, b)
    begin = np.concatenate(([0], a[:-1]))
    want = [[j for j in range(len(b)) if b[j] > s and (b[j - 1] if j else 0) < e] for s, e in zip(begin, a)]
    assert [list(range(f, e)) for f, e in zip(first, end)] == want


def statistics(rows, coders):
    links = {}
    total = Counter()
    for k, (_d, text) in enumerate(rows):
        got = plain(text, coders)
        links[k] = [] if got is None else [(g[-1], h[-1]) for g, h in got[2]]
        total.update(links[k])
    best = {}
    for (_a, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for k, (d, text) in enumerate(rows):
        got = plain(text, coders) or ([], [], [])
        out.append((d, len(got[0]), len(got[1]), len(got[2]), len(links[k]), sum(total[x] == best[x[1]] for x in links[k]),
                    sum(total[x] for x in links[k]), hashlib.sha256(told(got[2]).encode()).hexdigest() if got[2] else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_pairs", [1 << 20, 40])
def test_statistics(spark, odd_docs, odd_rows, coders, slice_pairs):
    got = A.link_statistics(odd_docs, BYTE, PIECE, slice_pairs=slice_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == statistics(odd_rows, coders)


def test_statistics_of_the_tables(spark, small_docs, coders):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in A.link_statistics(small_docs, BYTE, PIECE).collect()), key=str) == statistics(rows, coders)


def test_empty_table(spark, no_docs):
    assert A.link_statistics(no_docs, BYTE, PIECE).collect() == []
