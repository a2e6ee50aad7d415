"""Streaming operators: the same function on a file stream (availableNow)
equals the batch result; the stateful quota equals a brute-force fold."""

import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from codelens.plans import bindings as V
from codelens.streaming import progress as P

SF = "/root/testdata/sf0.001"


def _run_stream(spark, df, mode="update"):
    name = "q_" + next(tempfile._get_candidate_names())
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _progress_source(spark):
    out = tempfile.mkdtemp(prefix="prog-", dir="/tmp")
    batch = V.v_progress(spark, SF)
    batch.repartition(4).write.mode("overwrite").parquet(out)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(out)


def test_latest_status_stream_equals_batch(spark):
    batch, stream = _progress_source(spark)
    want = sorted(map(tuple, P.latest_status(batch, "event_id").collect()))
    got = sorted(map(tuple, _run_stream(spark, P.latest_status(stream, "event_id"), "complete").collect()))
    assert got == want and len(got) > 0


def brute_quota(rows, max_requests, window_ms):
    out = {}
    state = {}
    for key, ts in sorted(rows, key=lambda r: (r[0], r[1])):
        t = int(pd.Timestamp(ts).value // 1_000_000)
        reset, count = state.get(key, (None, 0))
        if reset is None or t >= reset:
            reset, count = t + window_ms, 0
        count += 1
        state[key] = (reset, count)
        out.setdefault(key, []).append((count, max(0, max_requests - count), count > max_requests))
    return out


def test_request_quota_batch_matches_fold(spark):
    req = V.v_requests(spark, SF)
    rows = [(r.ip, r.ts) for r in req.select("ip", "ts").collect()]
    want = brute_quota(rows, 5, 600_000)
    got = {}
    for r in P.request_quota(req, 5, 600_000, key="ip").orderBy("key", "ts", "count").collect():
        got.setdefault(r.key, []).append((r["count"], r.remaining, r.limited))
    assert got == want
    assert any(v[2] for vals in got.values() for v in vals)


def test_request_quota_skips_paths(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("1.1.1.1", "/api/browsers/x", t0), ("1.1.1.1", "/api/a", t0 + dt.timedelta(seconds=1)),
            ("1.1.1.1", "/api/a", t0 + dt.timedelta(seconds=2)), ("1.1.1.1", "/api/a", t0 + dt.timedelta(seconds=61)),
            ("2.2.2.2", "/socket.io/x", t0)]
    df = spark.createDataFrame(rows, "ip string, path string, ts timestamp")
    got = [(r["count"], r.remaining, r.limited) for r in P.request_quota(df, 2, 60_000).orderBy("key", "ts").collect()]
    # window opens at the first counted request (t0+1s) and re-opens at t0+61s
    assert got == [(1, 1, False), (2, 0, False), (1, 1, False)]


def test_request_quota_stream_equals_batch(spark):
    """Micro-batches in time order, rows within each in any order."""
    req = V.v_requests(spark, SF).select("ip", "path", "ts")
    src = tempfile.mkdtemp(prefix="req-", dir="/tmp")
    times = sorted(r.ts for r in req.select("ts").collect())
    cuts = [times[0], times[len(times) // 3], times[2 * len(times) // 3], dt.datetime(2100, 1, 1)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = req.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(src)
    cols = ["key", "ts", "count", "remaining", "limited", "reset_ts"]
    got = _run_stream(spark, P.request_quota(stream, 5, 600_000, key="ip"), "append")
    b = P.request_quota(req, 5, 600_000, key="ip")
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_request_quota_stream_sorts_a_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    src = tempfile.mkdtemp(prefix="req-", dir="/tmp")
    schema = "ip string, path string, ts timestamp"
    spark.createDataFrame([("a", "/x", t0 + dt.timedelta(seconds=s)) for s in (50, 10, 30)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    got = _run_stream(spark, P.request_quota(stream, 5, 60_000), "append").orderBy("ts").collect()
    assert [r["count"] for r in got] == [1, 2, 3] and {r.reset_ts for r in got} == {t0 + dt.timedelta(seconds=70)}


def test_eta_and_stage_helpers(spark):
    rows = [("a", 50.0, "progress", dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 10)),
            ("b", 0.0, "progress", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 3)),
            ("c", 100.0, "done", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1))]
    df = spark.createDataFrame(rows, "id string, progress double, kind string, first_ts timestamp, last_ts timestamp")
    got = {r.id: r.eta_ms for r in P.eta(df).collect()}
    assert got == {"a": 10_000, "b": 297_000, "c": 0}
    st = spark.createDataFrame([("Cloning repo", 10.0), ("", 80.0), ("weird", 30.0), (None, 0.0)], "step string, p double")
    stages = [r.s for r in st.select(P.pipeline_stage(F.col("step"), F.col("p")).alias("s")).collect()]
    assert stages == ["Clone", "Report", "Analyze", "Clone"]


def test_merge_findings_foreach_batch(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="sev-", dir="/tmp"), "summary")
    counts = spark.createDataFrame([("s1", 2, 1, 0), ("s2", 0, 0, 3)], "scan_id string, high long, medium long, low long")
    handle = P.merge_findings_batch(target)
    handle(counts, 0)
    handle(counts.filter(F.col("scan_id") == "s1"), 1)
    handle(counts.filter(F.col("scan_id") == "s1"), 1)   # replayed batch: no double count
    got = {r.scan_id: (r.high, r.moderate, r.low) for r in spark.read.parquet(target).collect()}
    assert got == {"s1": (4, 2, 0), "s2": (0, 0, 3)}
    for epoch in range(3):   # another stream counts its epochs from 0 and still adds up
        P.merge_findings_batch(target, stream="other")(counts, epoch)
    got = {r.scan_id: (r.high, r.moderate, r.low) for r in spark.read.parquet(target).collect()}
    assert got == {"s1": (10, 5, 0), "s2": (0, 0, 12)}


def test_merge_fails_on_an_unreadable_table(spark):
    import pytest
    target = os.path.join(tempfile.mkdtemp(prefix="sev-", dir="/tmp"), "summary")
    os.makedirs(os.path.join(target, "scan_id=s1"))
    with open(os.path.join(target, "scan_id=s1", "part-0.parquet"), "wb") as f:
        f.write(b"no parquet")
    counts = spark.createDataFrame([("s1", 2, 1, 0)], "scan_id string, high long, medium long, low long")
    with pytest.raises(Exception):
        P.merge_findings_batch(target)(counts, 0)
    assert os.listdir(os.path.join(target, "scan_id=s1")) == ["part-0.parquet"]


def test_running_sum_without_exchange_reuse(spark):
    from codelens.operators.ordered import running_sum
    rows = [(None if i % 5 == 0 else i % 3, i, 2**53 + i if i < 3 else 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, o int, v long").repartition(5)
    want, total = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[o] = total[k]
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.o: r.s for r in running_sum(df, ["k"], ["o"], F.col("v"), "s", 7).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    assert got == want


def test_detect_stream(spark):
    src = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    spark.createDataFrame([("s", "a.js", 10, "fetch('/x')"), ("s", "b.css", 10, ".a { display: grid; grid-area: a; }")],
                          "scan_id string, path string, size long, content string").write.mode("overwrite").parquet(src)
    got = sorted(r.feature for r in _run_stream(spark, P.detect_stream(spark, src), "append").collect())
    assert got == ["css-grid", "fetch"]


def test_timed_out_stream_event_time_timer(spark):
    src = tempfile.mkdtemp(prefix="prog-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 1)
    first = [("a", t0, "progress"), ("b", t0, "progress"), ("c", t0, "progress")]
    later = [("b", t0 + dt.timedelta(minutes=5), "progress"), ("c", t0 + dt.timedelta(minutes=1), "done"),
             ("z", t0 + dt.timedelta(hours=3), "progress")]   # moves the watermark far ahead
    schema = "id string, ts timestamp, kind string"
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "q_" + next(tempfile._get_candidate_names())
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    q = P.timed_out_stream(stream, 30 * 60 * 1000, "1 minute").writeStream.outputMode("append").format(
        "memory").queryName(name).option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.processAllAvailable()   # a further (empty) batch lets the advanced watermark fire the timers
    q.stop()
    got = sorted((r.id, r.kind) for r in spark.table(name).collect())
    assert got == [("a", "timed_out"), ("b", "timed_out")]          # c finished; z is still within its limit


def _state_rows(query):
    return sum(int(o["numRowsTotal"]) for p in query.recentProgress[-1:] for o in p["stateOperators"])


def test_quota_forgets_idle_keys(spark):
    """The state of keys whose window is over goes when the watermark passes it; the counts go on."""
    src = tempfile.mkdtemp(prefix="req-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 1)
    schema = "ip string, path string, ts timestamp"
    batches = [[(f"k{i}", "/x", t0 + dt.timedelta(seconds=i)) for i in range(50)],
               [("k1", "/x", t0 + dt.timedelta(seconds=30)), ("k7", "/x", t0 + dt.timedelta(hours=1))],
               [("k7", "/x", t0 + dt.timedelta(hours=1, seconds=1)), ("k8", "/x", t0 + dt.timedelta(hours=1, seconds=2))]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "q_" + next(tempfile._get_candidate_names())
    q = (P.request_quota(stream, 1, 60_000, watermark="1 minute").writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ck-", dir="/tmp")).start())
    q.processAllAvailable()
    q.processAllAvailable()
    rows, kept = spark.table(name).collect(), _state_rows(q)
    q.stop()
    assert len(rows) == 54
    limited = {(r.key, r.ts) for r in rows if r.limited}
    assert limited == {("k1", t0 + dt.timedelta(seconds=30)), ("k7", t0 + dt.timedelta(hours=1, seconds=1))}
    assert kept <= 8   # k7 and k8 (value, timer and its index), not the fifty


def test_timeout_fires_once_and_again_after_new_events(spark):
    src = tempfile.mkdtemp(prefix="prog-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 1)
    schema = "id string, ts timestamp, kind string"
    hours = lambda h: t0 + dt.timedelta(hours=h)
    for b in ([("a", t0, "progress")], [("z", hours(2), "progress")], [("z", hours(3), "progress")],
              [("a", hours(4), "progress"), ("z", hours(4), "done")], [("y", hours(9), "done")]):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted((r.id, r.last_ts) for r in _run_stream(spark, P.timed_out_stream(stream, 30 * 60 * 1000, "1 minute"), "append").collect())
    assert [g for g in got if g[0] == "a"] == [("a", t0), ("a", hours(4))]
    assert len(got) == len(set(got))
