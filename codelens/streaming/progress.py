"""Scan progress, quotas and incremental merges on Structured Streaming
(STR-01..11).

Every operator here is written once against a DataFrame and runs unchanged on
a batch table or a ``readStream`` source: aggregates are keyed by scan id
(update mode), and the two stateful operators keep O(1) state per key with
``transformWithState`` (``keyed.py``).  Batch twins exist for the oracle and for
backfills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions.scalar import round_half_up
from codelens.operators.quota import anchored_quota
from codelens.streaming.keyed import Quota, Timeout, keyed

TERMINAL = ["done", "failed", "cancelled"]


def epoch_ms(c: Column) -> Column:
    """Milliseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (read in
    the session time zone, UTC here)."""
    return F.unix_millis(c.cast("timestamp"))


def ts_lit(v) -> Column:
    """A timestamp literal from a datetime or ISO text, in the session zone."""
    if isinstance(v, Column):
        return v.cast("timestamp")
    text = v.isoformat(sep=" ") if hasattr(v, "isoformat") else str(v)
    return F.lit(text).cast("timestamp")


def latest_status(events: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """STR-01: per scan id the latest (by ts, then ``tiebreak``) progress /
    step / kind, the first and last event time.  A grouped ``max_by`` — valid
    in streaming update mode, and partial-aggregated in batch."""
    order = F.struct("ts", tiebreak) if tiebreak else F.col("ts")
    return events.groupBy("id").agg(
        F.max_by(F.struct("progress", "step", "kind"), order).alias("last"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(
        "id", "last.progress", "last.step", "last.kind", "first_ts", "last_ts")


def eta(status: DataFrame) -> DataFrame:
    """STR-02: ``eta_ms = round(elapsed x (100 - p) / p)`` with p clamped to
    1..99 and elapsed = last - first event time; 0 once terminal."""
    p = F.least(F.lit(99.0), F.greatest(F.lit(1.0), F.coalesce(F.col("progress").cast("double"), F.lit(0.0))))
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros(F.col("last_ts").cast("timestamp"))
                                      - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1000.0)
    v = round_half_up(elapsed * ((100 - p) / p)).cast("long")
    return status.withColumn("eta_ms", F.when(F.col("kind").isin(*TERMINAL), F.lit(0).cast("long")).otherwise(v))


def eta_batch(scans: DataFrame, now) -> DataFrame:
    """STR-03: done or progress >= 100 -> 0; progress > 0 -> round(elapsed x
    (100 - p) / p) with elapsed from ``created_at`` to ``now``; else NULL."""
    p = F.coalesce(F.col("progress").cast("double"), F.lit(0.0))
    elapsed = epoch_ms(ts_lit(now)) - epoch_ms(F.col("created_at"))
    return scans.withColumn("eta_ms", F.when((F.col("status") == "done") | (p >= 100), F.lit(0).cast("long"))
                            .when(p > 0, round_half_up(elapsed * ((100 - p) / p)).cast("long")))


def pipeline_stage(step: Column, pct: Column, complete: Column | None = None) -> Column:
    """STR-04: step text -> Clone / Analyze / Modernize / Report; unknown
    steps fall back to the quarter of the (clamped) percentage."""
    s = F.lower(F.coalesce(step, F.lit("")))
    named = (F.when(s == "", None).when(s.contains("clone"), "Clone")
             .when(s.contains("analy") | s.contains("parse"), "Analyze")
             .when(s.contains("modern") | s.contains("migrate") | s.contains("suggest"), "Modernize")
             .when(s.contains("report") | s.contains("final") | s.contains("result"), "Report"))
    p = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(pct.cast("double"), F.lit(0.0))))
    by_pct = F.when(p >= 75, "Report").when(p >= 50, "Modernize").when(p >= 25, "Analyze").otherwise("Clone")
    if complete is not None:
        by_pct = F.when(complete, F.lit("Report")).otherwise(by_pct)
    return F.coalesce(named, by_pct)


def file_progress(files: DataFrame) -> DataFrame:
    """STR-05: progress after the i-th file of n (1-based, path order) =
    50 + round(i / n x 30).  The position is a distributed row index (range
    partitioned, no whole-scan window) and n a grouped count joined back."""
    from codelens.operators.ordered import row_index
    f = files.select("scan_id", "path")
    idx = row_index(f, ["scan_id"], ["path"], "i")
    n = f.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    return idx.join(n, "scan_id").select("scan_id", "path", F.col("i").cast("long").alias("i"), "n").withColumn(
        "progress", (50 + round_half_up(F.col("i") / F.col("n") * 30)).cast("long"))


def terminal_status(status: Column) -> tuple[Column, Column]:
    """STR-10: (final status, completed flag).  done / cancelled / failed
    stay; anything else is still running."""
    s = F.lower(F.coalesce(status, F.lit("")))
    final = F.when(s.isin(*TERMINAL), s).otherwise(F.lit("processing"))
    return final, s.isin(*TERMINAL)


def cancel_allowed(status: Column) -> Column:
    """STR-10: a cancel request changes a scan only if it is not terminal."""
    return ~F.lower(F.coalesce(status, F.lit(""))).isin(*TERMINAL)


def timed_out(status: DataFrame, now, limit_ms: int) -> DataFrame:
    """STR-08 (batch form): scans not terminal whose last event is older than
    ``limit_ms`` at ``now``."""
    return status.filter(~F.col("kind").isin(*TERMINAL) & (
        epoch_ms(ts_lit(now)) - epoch_ms(F.col("last_ts")) > F.lit(limit_ms)))


TIMEOUT_OUT = "id string, last_ts timestamp, kind string"

def timed_out_stream(events: DataFrame, limit_ms: int, watermark: str = "10 minutes") -> DataFrame:
    """STR-08 on a stream: an event-time timer per scan id (state: last event
    time and kind).  When the watermark passes ``last event + limit`` without
    a newer event and the scan is not terminal, one ``timed_out`` row is
    emitted and the state removed; terminal scans drop their state at once.
    The watermark delay is the tolerated lateness of progress events (events
    later than that are not considered, as for any event-time timer)."""
    e = events.select(F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "kind")
    return keyed(e, "id", Timeout(limit_ms, TERMINAL), TIMEOUT_OUT, watermark)


# -- request quotas (STR-06 / STR-07) ------------------------------------------

QUOTA_OUT = "key string, ts timestamp, count long, remaining long, limited boolean, reset_ts timestamp"

def request_quota(requests: DataFrame, max_requests: int = 60, window_ms: int = 60_000,
                  key: str = "ip", skip_prefixes: list[str] | None = None, watermark: str = "10 minutes") -> DataFrame:
    """STR-06: fixed window per key that opens at the key's first request (and
    re-opens at the first request after it closes); each request gets its
    running count, ``remaining = max(0, max - count)`` and ``limited`` when the
    count exceeds the maximum.  Paths with a skip prefix are not counted.

    Streaming: ``transformWithState`` with two longs per key in RocksDB (append
    mode; arrival order across micro-batches), which are dropped when the watermark
    passes the window's end; requests later than ``watermark`` are not considered.
    Batch: ``quota.anchored_quota``, in which a hot key is folded by many tasks.
    STR-07 is the same operator keyed by tenant."""
    skip = skip_prefixes if skip_prefixes is not None else ["/socket.io", "/api/browsers"]
    r = requests
    for p in skip:
        r = r.filter(~F.col("path").startswith(p))
    r = r.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    if r.isStreaming:
        return keyed(r, "key", Quota(max_requests, window_ms), QUOTA_OUT, watermark)
    return anchored_quota(r, max_requests, window_ms)


def request_quota_aligned(requests: DataFrame, max_requests: int = 60, window: str = "60 seconds",
                          key: str = "ip") -> DataFrame:
    """STR-06, aligned variant: tumbling windows instead of first-request
    anchoring; a per-window running count (SQL-expressible twin)."""
    w = Window.partitionBy(key, "win").orderBy("ts", "seq")
    r = requests.withColumn("win", F.window("ts", window)["start"])
    c = F.row_number().over(w)
    return r.withColumn("count", c.cast("long")).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(max_requests) - F.col("count")).cast("long")).withColumn(
        "limited", F.col("count") > max_requests)


def token_quota(requests: DataFrame, capacity: int = 10, refill_ms: int = 60_000, key: str = "tenant") -> DataFrame:
    """STR-07: suggestion quota — ``capacity`` calls per ``refill_ms``,
    refilled in full, lazily, on the first call after the interval."""
    return request_quota(requests, capacity, refill_ms, key=key, skip_prefixes=[])


def merge_findings_batch(target_path: str, key: str = "scan_id", stream: str | None = None):
    """STR-09: ``foreachBatch`` handler — fold a micro-batch of tool counts
    into the stored severity summary (AGG-09) and upsert it by scan id
    (SNK-05) into the parquet table at ``target_path``.

    Idempotent under re-execution: each stored row carries, per stream, the
    epoch of the micro-batch that last changed it; a replayed batch (foreachBatch
    is at-least-once) skips the scans that already have it.  Streams are told apart by
    ``stream`` or, by default, by the query id, which a restart from the same
    checkpoint keeps and a new checkpoint changes.  Only the partitions of the
    batch's scans are read and rewritten.  A missing table is an empty one; any
    other failure to read it fails the batch.
    """
    from codelens.operators.score import merge_severity
    from codelens.sources.sinks import upsert_table

    cols = ["low", "moderate", "high", "critical", "unknown"]
    schema = ", ".join(f"{c} long" for c in cols) + f", epochs map<string,long>, {key} string"

    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        name = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "default"
        target = spark._jvm.org.apache.hadoop.fs.Path(target_path)
        exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
        batch = batch.persist()
        try:
            ids = batch.select(F.col(key).cast("string").alias(key)).distinct()
            stored = spark.read.schema(schema).parquet(target_path) if exists else spark.createDataFrame([], schema)
            stored = stored.join(ids, key, "left_semi")
            seen = F.coalesce(F.try_element_at("epochs", F.lit(name)), F.lit(-1).cast("long"))
            done = stored.filter(seen >= epoch_id).select(key)
            todo = batch.join(done, key, "left_anti")
            touched = stored.join(todo.select(key).distinct(), key, "left_semi")
            others = touched.select(key, F.map_filter("epochs", lambda k, _v: k != name).alias("_others"))
            merged = merge_severity(touched.select(key, *cols), todo).join(others, key, "left")
            mine = F.create_map(F.lit(name), F.lit(epoch_id).cast("long"))
            merged = merged.withColumn("epochs", F.when(F.col("_others").isNull(), mine).otherwise(F.map_concat("_others", mine)))
            # the rows are written out before the partitions they were read from are replaced
            upsert_table(spark, target_path, merged.drop("_others").checkpoint(eager=True), key)
        finally:
            batch.unpersist()
    return handle


def detect_stream(spark, corpus_dir: str, schema: str = "scan_id string, path string, size long, content string"):
    """STR-11: detectors over corpus rows as they arrive (parquet file
    source); detectors are stateless, so they run unchanged."""
    from codelens.operators.detect import detect_features
    src = spark.readStream.schema(schema).parquet(corpus_dir)
    return detect_features(src)
