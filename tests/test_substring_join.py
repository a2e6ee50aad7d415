"""Substring join by n-grams against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from codelens.operators import baseline as B


def plain(keys, names):
    out = {}
    for k in keys:
        hits = [o for o, texts in names if any(k in t for t in texts)]
        if hits:
            out[k] = min(hits)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_containment(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcé-") for _ in range(r.randrange(n)))
    names = [(i, [text(12), text(9)]) for i in r.sample(range(1000), 60)]
    keys = sorted({text(7) for _ in range(120)} | {names[0][1][0], "", "zzzz", "aba"})
    got = B.first_containing(spark.createDataFrame([(k,) for k in keys], "key string"),
                             spark.createDataFrame(names, "ord long, texts array<string>"))
    rows = got.collect()
    assert len(rows) == len({x.key for x in rows}) and {x.key: x.ord for x in rows} == plain(keys, names)
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_empty_sides(spark):
    none = spark.createDataFrame([], "ord long, texts array<string>")
    keys = spark.createDataFrame([("abcd",), ("",)], "key string")
    assert B.first_containing(keys, none).collect() == []
    assert B.first_containing(keys.where(F.lit(False)), spark.createDataFrame([(1, ["x"])], "ord long, texts array<string>")).collect() == []


def test_lookup_takes_the_first_row(spark):
    base = spark.createDataFrame([("s", "f", k, "unknown", "") for k in ("Grid", "g", "fetch-api", "none", "core-js/full/array")]
                                 + [("s", "f", "fetch", "supported", "kept")], "scan_id string, file string, feature string, status string, notes string")
    base = base.withColumn("support", F.create_map(F.lit("chrome"), F.lit("unknown")))
    cat = spark.createDataFrame([(3, "CSS grid", "grid-3", "supported"), (2, "Subgrid", None, "partial"), (7, None, "the-fetch-api", "supported"),
                                 (7, "fetch-api", "a-fetch", "partial")], "ord long, name string, slug string, s string")
    cat = cat.select("ord", "name", "slug", F.create_map(F.lit("chrome"), F.col("s")).alias("support"))
    got = {r.feature: (r.status, r.notes) for r in B.lookup_web_features(base, cat).collect()}
    assert got["Grid"][1] == got["g"][1] == "Fallback from web-features for 'Subgrid'"
    assert got["fetch-api"][1] == "Fallback from web-features for 'a-fetch'"
    assert got["none"][1] == got["core-js/full/array"][1] == "" and got["fetch"] == ("supported", "kept")


def catalogue(spark, rows):
    """A catalogue of known size, which Spark takes for small until its texts are exploded."""
    key = F.concat(F.lit("part-"), F.col("id").cast("string"))
    return spark.range(rows).select(F.col("id").alias("ord"), F.concat(F.lit("Name of "), key).alias("name"), key.alias("slug"),
                                    F.create_map(F.lit("chrome"), F.lit("partial")).alias("support"))


def broadcasts(df):
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in x]


def test_the_catalogue_is_not_broadcast(spark):
    cat = catalogue(spark, 2000)
    names = cat.select("ord", F.array(F.lower("name"), "slug").alias("texts"))
    keys = ["art-19", "of part-777", "t-9", "", "9", "part-2000", "zz"]
    got = B.first_containing(spark.createDataFrame([(k,) for k in keys], "key string"), names)
    assert broadcasts(got) == []
    assert {r.key: r.ord for r in got.collect()} == {"art-19": 19, "of part-777": 777, "t-9": 9, "": 0, "9": 9}
    # also when the keys are known to be few, and after Spark has measured both sides
    few = spark.range(3).select(F.concat(F.lit("part-"), (F.col("id") + 1500).cast("string")).alias("key"))
    got = B.first_containing(few, names)
    assert {r.key: r.ord for r in got.collect()} == {f"part-{i}": i for i in (1500, 1501, 1502)}
    assert broadcasts(got) == []


def test_lookup_does_not_broadcast_the_catalogue(spark):
    base = spark.createDataFrame([("s", "f", k, "unknown", "") for k in ("PART-15", "none", "t-9")], "scan_id string, file string, feature string, status string, notes string")
    base = base.withColumn("support", F.create_map(F.lit("chrome"), F.lit("unknown")))
    got = B.lookup_web_features(base, catalogue(spark, 2000))
    assert broadcasts(got) == []
    label = "Fallback from web-features for 'part-{}'".format
    assert {r.feature: r.notes for r in got.collect()} == {"PART-15": label(15), "none": "", "t-9": label(9)}
