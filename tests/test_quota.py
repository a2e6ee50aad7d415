"""Splittable quotas against the plain fold, on keys that fill many partitions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens.operators import quota as Q
from codelens.plans import bindings as V
from codelens.plans import q_stream

T0 = dt.datetime(2024, 1, 1)


def fold(rows, max_requests, window_ms):
    out, state = [], {}
    for key, ms in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        reset, count = state.get(key, (None, 0))
        if reset is None or ms >= reset:
            reset, count = ms + window_ms, 0
        count += 1
        state[key] = (reset, count)
        out.append((key, ms, count, max(0, max_requests - count), count > max_requests, reset))
    return sorted(out, key=str)


def run(spark, rows, max_requests, window_ms, partitions=8):
    df = spark.createDataFrame([(k, T0 + dt.timedelta(milliseconds=m)) for k, m in rows], "key string, ts timestamp").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = Q.anchored_quota(df, max_requests, window_ms).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    ms = lambda t: round((t - T0).total_seconds() * 1000)
    return sorted(((r.key, ms(r.ts), r["count"], r.remaining, r.limited, ms(r.reset_ts)) for r in got), key=str)


def traffic(seed, n, span, keys):
    r = random.Random(seed)
    return [(r.choice(keys), r.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("seed, n, span, keys, window", [
    (1, 900, 100_000, ["hot"], 700),                            # one key fills all partitions, many windows in each
    (2, 900, 100_000, ["hot"], 40_000),                         # a window spans partitions
    (3, 900, 500, ["hot"], 10_000),                             # one window holds everything
    (4, 900, 60, ["hot"], 7),                                   # many requests at the same time
    (5, 900, 50_000, ["hot"] * 8 + ["a", "z", None, ""], 900),  # a hot key between others
    (6, 600, 30_000, [f"k{i}" for i in range(90)], 2_000),      # many small keys
])
def test_equals_the_fold(spark, seed, n, span, keys, window):
    rows = traffic(seed, n, span, keys)
    assert run(spark, rows, 5, window, 8) == fold(rows, 5, window)


def test_a_burst_at_one_time(spark):
    rows = [("a", 5)] * 300 + [("a", 7)] * 2 + [("b", 5)]
    assert run(spark, rows, 100, 3) == fold(rows, 100, 3)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "key string, ts timestamp")
    assert Q.anchored_quota(none, 5, 1000).collect() == []
    assert Q.anchored_quota(spark.createDataFrame([("a", None), (None, T0)], "key string, ts timestamp"), 5, 1000).count() == 1


def test_a_hot_key_is_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.timestamp_millis(F.col("id") * 37).alias("ts"))
    got = Q.anchored_quota(rows, 60, 60_000)
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 1 and max(sizes) < 0.6 * 20_000 and sum(sizes) == 20_000


def test_steps_are_bounded_by_the_window():
    r = np.random.default_rng(0)
    ms = np.sort(r.integers(0, 10**7, 200_000))
    final = Q.last_opening(Q.next_opening(np.zeros(len(ms), np.int64), ms, 60_000))
    entries = int(np.searchsorted(ms, ms[0] + 60_000, side="right"))
    assert len(np.unique(final[:entries])) <= 60_000


def test_queries_limit_some_requests(spark):
    for query in (q_stream.q_str06, q_stream.q_str07, q_stream.q_str06a):
        seen = {r.limited for r in query(spark, "/root/testdata/sf0.01").select("limited").distinct().collect()}
        assert seen == {True, False}
    assert V.v_requests(spark, "/root/testdata/sf0.01").count() == 10_000
