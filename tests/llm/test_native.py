"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from codelens.llm import mixing, sharding


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 123456789, *range(2, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 1000):
        got = {r[0]: r[1] for r in df.select("k", sharding.jump_hash(F.col("k"), n)).collect()}
        assert got == {k: brute.jump(k, n) for k in keys}


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_shard_slots(which, request):
    docs = request.getfixturevalue(which)
    rows = sharding.shard_slots(docs, 16).collect()
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        b = (t or "").encode()
        want[(d, len(b) + 1, zlib.crc32(b), brute.jump(d or 0, 16), brute.jump(d or 0, 17))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    assert all(r["law"] == "key" and r["grown_shard"] in (r["shard"], 16) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_copies_of_one_row(spark):
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_slots(docs, 16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(3000))


def test_assign_shards_keeps_columns(odd_docs):
    out = sharding.assign_shards(odd_docs, 16)
    assert out.columns == [*odd_docs.columns, "shard", "grown_shard"] and out.count() == odd_docs.count()


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_mix(which, request):
    docs = request.getfixturevalue(which)
    rows = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter(
        (d, len(brute.words(t)), s) for d, t, s in docs.select("doc_id", "text", "source").collect())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 2
    total = sum(r["size"] for r in rows)
    for i, source in enumerate(sorted(by, key=lambda s: (s is None, s or ""))):
        group = by[source]
        own = sum(r["size"] for r in group)
        assert {r["source_size"] for r in group} == {own} and len({r["target"] for r in group}) == 1
        assert group[0]["target"] <= 2 * own
        taken = sum(r["size"] * r["copies"] for r in group)
        assert abs(taken - group[0]["target"]) <= max(r["size"] for r in group) / 2 + 1e-6
    targets = {s: g[0]["target"] for s, g in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    # the sources below their cap are in proportion to their weights
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    free = {targets[s] / weights[s] for s in by if targets[s] < 2 * by[s][0]["source_size"] - 1e-6}
    assert not free or max(free) == pytest.approx(min(free))
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_mixed_documents(which, request):
    docs = request.getfixturevalue(which)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    assert Counter((r["doc_id"], len(brute.words(r["text"]))) for r in out.collect()) == +want


def test_importance_raises_the_chance(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"),
                                    F.when(F.col("id") % 2 == 0, 4.0).otherwise(0.25).alias("weight"))
    rows = mixing.mix(docs, total_share=0.4, importance="weight").collect()
    assert sum(r["copies"] for r in rows) == 1600
    heavy = sum(r["copies"] for r in rows if r["doc_id"] % 2 == 0)
    assert heavy > 1300


def test_weights_follow_code_points(spark):
    names = ["Z", "a", "é", "B", None]
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(names)], "doc_id long, text string, source string")
    sizes = docs.groupBy("source").agg(F.count("*").alias("source_size"))
    got = {r["source"]: r["weight"] for r in mixing.cycling_weights(sizes, (5, 2, 1)).collect()}
    assert got == {"B": 5, "Z": 2, "a": 1, "é": 5, None: 2}
