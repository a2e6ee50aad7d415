"""Merkle manifest against plain trees, on odd rows, groups of every size and deep trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from codelens.llm import merkle_manifest as M

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the rows of the query."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*map(field, r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([leaf for *_k, leaf, _r in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for at, g in enumerate(order):
        for i, (*_k, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            told = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                told = H(*map(field, (*r[:3], None if r[3] is None else r[3] + 1, r[4])))
            node, siblings = told, []
            for tree, p in ((trees[at], i), (top, at)):
                for level in tree[:-1]:
                    if p ^ 1 < len(level):
                        siblings.append(level[p ^ 1])
                        node = H(level[p ^ 1], node) if p % 2 else H(node, level[p ^ 1])
                    else:
                        node = H(node)
                    p //= 2
            out.append((r[0], leaf, trees[at][-1][0], top[-1][0], H(*siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


def audit(docs):
    got = M.audit(docs, M.tampered_leaf())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_odd_rows(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select(*COLUMNS).collect()]
    got = audit(odd_docs)
    assert got == plain(rows) and any(not r[6] for r in got) and any(r[6] for r in got)


def test_small_table(small_docs):
    assert audit(small_docs) == plain([tuple(r) for r in small_docs.select(*COLUMNS).collect()])


def test_empty_table(no_docs):
    assert audit(no_docs) == [] and M.build(no_docs) is None


def test_groups_of_every_size(spark):
    """One, two, three leaves, just around the width of a stored subtree, and deep ones together."""
    sizes = [1, 2, 3, 63, 64, 65, 128, 129, 4097]
    rows = [(1000 * g + i, "s", f"g{g}", i, f"text {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = M.build(docs)
    assert (manifest.stages, manifest.top_stages) == (3, 1)
    assert audit(docs) == plain(rows)


@pytest.mark.parametrize("n", [64, 65, 130])
def test_many_groups(spark, n):
    rows = [(i, None, f"é{i % n}" if i % n else None, None, None) for i in range(2 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert M.build(docs).top_stages == (1 if n <= 64 else 2)
    assert audit(docs) == plain(rows)


def test_one_group_of_copies(spark):
    """A row that fills a third of the table is counted before it is placed."""
    rows = [(7, "s", "en", 3, "same")] * 700 + [(i, "s", "en", 3, "other") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert audit(docs) == plain(rows)


def test_only_some_levels_are_stored_and_proofs_fold(spark, small_docs):
    manifest = M.build(small_docs)
    stored = manifest.level("groups", 0).select(F.explode("nodes")).count()
    assert stored == small_docs.count()
    nodes = manifest.level("groups", 0).select(F.size("nodes").alias("n")).agg(F.max("n")).first()[0]
    assert nodes <= M.SPAN
    for r in manifest.proofs().limit(20).collect():
        assert M.fold(r.node, r.proof) == r.root and M.fold(r.told, r.proof) == r.root
        assert M.fold(H(r.node), r.proof) != r.root


def test_large_numbers_and_string_keys(spark):
    rows = [(f"k{i}", "s", "x", 9223372036854775807 if i == 3 else i, "t") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, lang string, n_chars long, text string")
    got = M.audit(docs, M.tampered_leaf(divisor=1)).collect()
    assert len(got) == 70 and not any(r.verified for r in got)
    assert {r.leaf for r in got} == {H(*map(field, r)) for r in rows}
