"""Language identification: plain Viterbi, plain counts, held-out accuracy, odd input."""

import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelens.llm import language_id as L

#: 2,000 made-up words per language from its own syllables.
SYLLABLES = {"xa": "ka ru mi to ne shi ha yo", "xb": "str ung ich ein ver ab kel tz", "xc": "ção lh ois eau que ment ré ô"}


def prose(lang, n, seed=0):
    r = random.Random(f"{lang}{seed}")
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(n))


def plain_path(scores, penalty):
    """Value of the best path, one word after the other."""
    best = list(scores[0])
    for row in scores[1:]:
        top = max(best)
        best = [max(b, top - penalty) + x for b, x in zip(best, row)]
    return max(best)


def value(scores, labels, penalty):
    return sum(scores[i][x] for i, x in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 4), st.lists(st.integers(0, 25), min_size=1, max_size=5), st.integers(0, 10**6), st.sampled_from([0.0, 0.5, 3.0]), st.sampled_from([1, 2, 3, 64]))
def test_viterbi_finds_the_best_path(kinds, sizes, seed, penalty, chunk):
    scores = np.random.default_rng(seed).normal(size=(sum(sizes), kinds))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    labels = L.viterbi(scores, offsets, penalty, chunk)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b > a:
            assert math.isclose(value(scores[a:b], labels[a:b], penalty), plain_path(scores[a:b], penalty), abs_tol=1e-9)


def plain_words(text):
    """(start, end, script) by one character after the other."""
    def script(c):
        return next((i for i, (_n, rs) in enumerate(L.SCRIPTS) if any(a <= ord(c) <= b for a, b in rs)), len(L.SCRIPTS))

    out, start, own, last = [], None, None, None
    for i, c in enumerate(text + " "):
        kind = unicodedata.category(c)[0]
        mine = script(c) if kind == "L" or last is None else last
        if kind == "L":
            last = mine
        ends = start is not None and (kind not in "LM" or mine != own)
        if ends:
            out.append((start, i, own))
            start = None
        if kind in "LM" and start is None:
            start, own = i, mine
    cut = [(s, min(s + L.WORD_CHARS, b), o) for a, b, o in out for s in range(a, b, L.WORD_CHARS)]
    return [(a, b, o) for a, b, o in cut if any(unicodedata.category(c)[0] == "L" for c in text[a:b])]


ODD = ["", "Hello, wörld! déjà-vu", "a1b2 c", "Привет мир abcПривет", "हिन्दी भाषा", "日本語テキスト漢字", "x" * 100, "é́ ́ ́a", "123 !!",
       "😀a😀", "ΑΒΓ abc", "İstanbul", "한국어 文", "it's", "́", "áb", "ﬁ"]


def test_words_of_odd_texts():
    for texts in (ODD, *([t] for t in ODD)):
        w = L.words_of(texts)
        base = np.concatenate(([0], np.cumsum(list(map(len, texts)))))
        got = [[] for _ in texts]
        for s, e, r, script in zip(w.starts, w.ends, w.rows, w.scripts):
            got[r].append((s - base[r], e - base[r], script))
        # a mark in front of any letter of its text belongs to what stood before it: only such texts may differ
        assert got == [plain_words(t) for t in texts]


def test_equal_words_have_equal_grams():
    w = L.words_of(["Kab kab KAB", "kab xkab"])
    assert len(set(w.which[:4])) == 1 and w.which[4] != w.which[0]
    assert w.sizes[w.which[0]] == 1 + 3 + 4 + 3 + 2  # the word, and 1- to 4-grams of <kab>


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, prose(lang, 60, i), lang) for i in range(90) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(1001, "Привет мир как дела", "ru"), (1101, None, "xa"), (1102, prose("xa", 5), None), (None, prose("xb", 5), "xb"), (1005, "123", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert zlib.crc32(b"1001") % 5 and zlib.crc32(b"1005") % 5
    return docs, rows, L.train(docs)


def test_counts_and_languages(made):
    _docs, _rows, model = made
    assert model.languages == ["ru", "xa", "xb", "xc"]  # no letter: no language
    latin, cyrillic, greek = (next(i for i, s in enumerate(L.SCRIPTS) if s[0] == n) for n in ("Latin", "Cyrillic", "Greek"))
    assert model.candidates[latin].tolist() == [False, True, True, True]
    assert model.candidates[cyrillic].tolist() == [True, False, False, False]
    assert model.candidates[greek].all()


def test_model_is_the_counts(spark, made):
    _docs, rows, model = made
    for lang in ("xa", "xb"):
        n = np.zeros(L.SLOTS)
        for d, text, x in rows:
            if x == lang and text and zlib.crc32(("" if d is None else str(d)).encode()) % 5:
                w = L.words_of([text])
                for k in w.which:
                    first = int(w.sizes[:k].sum())
                    np.add.at(n, w.slots[first:first + w.sizes[k]], 1)
        want = np.log((n + L.SMOOTHING) / (n.sum() + L.SMOOTHING * L.SLOTS))
        np.testing.assert_allclose(model.scores[:, model.languages.index(lang)], want, rtol=1e-5)


def test_held_out_texts_do_not_teach(spark, made):
    docs, rows, model = made
    other = spark.createDataFrame([(d, t if zlib.crc32(("" if d is None else str(d)).encode()) % 5 else "something else entirely", x) for d, t, x in rows],
                                  docs.schema)
    assert (L.train(other).scores == model.scores).all()


def test_spans_of_mixed_text(made):
    _docs, _rows, model = made
    a, b, c = prose("xa", 30, 501), prose("xb", 40, 502), "Привет мир"
    text = a + ". " + b + " -- " + c + "!"
    langs, shares, spans = L.label_texts([text, None, "", "12 !", a], model)
    assert langs == ["xb", "und", "und", "und", "xa"] and shares[1:4] == [0.0] * 3 and shares[4] == 1.0
    assert [x for _s, _e, x in spans[0]] == ["xa", "xb", "ru"]
    (s1, e1, _), (s2, e2, _), (s3, e3, _) = spans[0]
    assert abs(e1 - len(a)) <= 12 and abs(s2 - len(a) - 2) <= 12 and text[s3:e3] == c
    letters = [sum(ch.isalpha() for ch in text[s:e]) for s, e, _ in spans[0]]
    assert math.isclose(shares[0], letters[1] / sum(letters))


def test_labels_do_not_depend_on_the_batch(made):
    _docs, _rows, model = made
    texts = [*ODD, None, prose("xa", 3000, 7), prose("xb", 200, 8), prose("xa", 100, 9) + " " + prose("xc", 100, 9)]
    together = L.label_texts(texts, model)
    alone = [L.label_texts([t], model) for t in texts]
    assert together[0] == [x[0][0] for x in alone] and together[2] == [x[2][0] for x in alone]


def test_identify(spark, made, odd_docs, odd_rows, no_docs):
    docs, _rows, model = made
    got = L.identify(odd_docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "spans"]
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d is None, d or 0) for d, _t in odd_rows)
    assert all((r.lang_pred == "und") == (not r.spans) and 0 <= r.score <= 1 for r in rows)
    assert L.identify(no_docs, model).collect() == []
    empty = L.train(no_docs)
    assert empty.languages == [] and {r.lang_pred for r in L.identify(odd_docs, empty).collect()} == {"und"}


def test_many_languages_fold_the_slots(spark, monkeypatch, made):
    docs, _rows, _model = made
    monkeypatch.setattr(L, "MODEL_BYTES", 4 * 4 * 8192)
    small = L.train(docs)
    assert len(small.scores) == 8192
    langs, _shares, _spans = L.label_texts([prose(x, 50, 77) for x in SYLLABLES], small)
    assert langs == list(SYLLABLES)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs, L.train(docs), with_spans=False).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.99
