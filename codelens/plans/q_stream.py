"""Queries: progress / quota operators on the events table (batch form of the
streaming operators; the same functions run on ``readStream`` sources, see
tests/test_streaming.py)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codelens.plans import bindings as V
from codelens.plans.catalog import ORACLE, register
from codelens.plans.q_scores import MERGE_SQL
from codelens.streaming import progress as P

PROG = f"({V.V_PROGRESS_SQL})"
STATUS_SQL = f"""
SELECT id, arg_max(progress, (ts, event_id)) AS progress, arg_max(step, (ts, event_id)) AS step,
       arg_max(kind, (ts, event_id)) AS kind, min(ts) AS first_ts, max(ts) AS last_ts
FROM {PROG} GROUP BY id
"""


def status(spark, sf_dir):
    return P.latest_status(V.v_progress(spark, sf_dir), tiebreak="event_id")


register("STR-01", STATUS_SQL)(status)

STR02_SQL = f"""
SELECT *, CASE WHEN kind IN ('done', 'failed', 'cancelled') THEN CAST(0 AS BIGINT)
  ELSE CAST(floor(greatest(0.0, (epoch_us(last_ts) - epoch_us(first_ts)) / 1000.0) * ((100 - least(99.0, greatest(1.0, coalesce(progress, 0.0))))
       / least(99.0, greatest(1.0, coalesce(progress, 0.0)))) + 0.5) AS BIGINT) END AS eta_ms
FROM ({STATUS_SQL})
"""


@register("STR-02", STR02_SQL)
def q_str02(spark, sf_dir):
    return P.eta(status(spark, sf_dir))


NOW = dt.datetime(1999, 1, 1)
STR03_SQL = f"""
SELECT id, status, progress, created_at,
  CASE WHEN status = 'done' OR progress >= 100 THEN CAST(0 AS BIGINT)
       WHEN progress > 0 THEN CAST(floor((epoch_ms(TIMESTAMP '1999-01-01 00:00:00') - epoch_ms(created_at)) * ((100 - progress) / progress) + 0.5) AS BIGINT)
  END AS eta_ms
FROM ({V.V_SCANS_SQL})
"""


@register("STR-03", STR03_SQL)
def q_str03(spark, sf_dir):
    s = V.v_scans(spark, sf_dir).select("id", "status", "progress", "created_at")
    return P.eta_batch(s, NOW)


LS = "lower(coalesce(step, ''))"
STR04_SQL = f"""
SELECT event_id, step, progress, coalesce(
  CASE WHEN {LS} = '' THEN NULL WHEN contains({LS}, 'clone') THEN 'Clone'
       WHEN contains({LS}, 'analy') OR contains({LS}, 'parse') THEN 'Analyze'
       WHEN contains({LS}, 'modern') OR contains({LS}, 'migrate') OR contains({LS}, 'suggest') THEN 'Modernize'
       WHEN contains({LS}, 'report') OR contains({LS}, 'final') OR contains({LS}, 'result') THEN 'Report' END,
  CASE WHEN least(100.0, greatest(0.0, coalesce(progress, 0.0))) >= 75 THEN 'Report'
       WHEN least(100.0, greatest(0.0, coalesce(progress, 0.0))) >= 50 THEN 'Modernize'
       WHEN least(100.0, greatest(0.0, coalesce(progress, 0.0))) >= 25 THEN 'Analyze' ELSE 'Clone' END) AS stage
FROM {PROG}
"""


@register("STR-04", STR04_SQL)
def q_str04(spark, sf_dir):
    p = V.v_progress(spark, sf_dir)
    return p.select("event_id", "step", "progress", P.pipeline_stage(F.col("step"), F.col("progress")).alias("stage"))


STR05_SQL = f"""
SELECT scan_id, path, i, n, CAST(50 + floor(i * 1.0 / n * 30 + 0.5) AS BIGINT) AS progress FROM (
  SELECT scan_id, path, row_number() OVER (PARTITION BY scan_id ORDER BY path) AS i,
         count(*) OVER (PARTITION BY scan_id) AS n FROM ({V.V_FILES_SQL}))
"""


@register("STR-05", STR05_SQL)
def q_str05(spark, sf_dir):
    return P.file_progress(V.v_files(spark, sf_dir))


@register("STR-06", None)
def q_str06(spark, sf_dir):
    """First-request-anchored quota per ip (stateful fold; checked against a
    brute-force fold in tests)."""
    return P.request_quota(V.v_requests(spark, sf_dir), 60, 60_000, key="ip")


STR06A_SQL = f"""
SELECT ip, path, ts, seq, win, count, CAST(greatest(0, 60 - count) AS BIGINT) AS remaining, count > 60 AS limited FROM (
  SELECT *, row_number() OVER (PARTITION BY ip, win ORDER BY ts, seq) AS count FROM (
    SELECT *, time_bucket(INTERVAL '60 seconds', ts) AS win FROM ({V.V_REQUESTS_SQL})))
"""


@register("STR-06-aligned", STR06A_SQL)
def q_str06a(spark, sf_dir):
    r = P.request_quota_aligned(V.v_requests(spark, sf_dir), 60, "60 seconds", key="ip")
    return r.select("ip", "path", "ts", "seq", "win", "count", "remaining", "limited")


@register("STR-07", None)
def q_str07(spark, sf_dir):
    """Suggestion quota per tenant: 10 calls per minute, full lazy refill."""
    return P.token_quota(V.v_requests(spark, sf_dir), 10, 60_000, key="tenant")


STR08_SQL = f"""
SELECT * FROM ({STATUS_SQL})
WHERE kind NOT IN ('done', 'failed', 'cancelled')
  AND epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(last_ts) > 86400000
"""


@register("STR-08", STR08_SQL)
def q_str08(spark, sf_dir):
    return P.timed_out(status(spark, sf_dir), dt.datetime(2024, 1, 31), 86_400_000)


STR10_SQL = f"""
SELECT id, status, CASE WHEN lower(status) IN ('done', 'failed', 'cancelled') THEN lower(status) ELSE 'processing' END AS final_status,
       lower(status) IN ('done', 'failed', 'cancelled') AS completed,
       NOT (lower(status) IN ('done', 'failed', 'cancelled')) AS cancel_allowed
FROM ({V.V_SCANS_SQL})
"""


@register("STR-10", STR10_SQL)
def q_str10(spark, sf_dir):
    s = V.v_scans(spark, sf_dir)
    final, done = P.terminal_status(F.col("status"))
    return s.select("id", "status", final.alias("final_status"), done.alias("completed"),
                    P.cancel_allowed(F.col("status")).alias("cancel_allowed"))


def _scratch(spark, sf_dir, name):
    import os
    from codelens.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/codelens-streams/{os.path.basename(sf_dir.rstrip('/'))}/{name}"


def _run_available_now(df, mode, target, ckpt, foreach=None):
    """Run a stream over what is there; the result goes to ``foreach`` or to
    Parquet files at ``target``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    q = w.foreachBatch(foreach).start() if foreach else w.format("parquet").option("path", target).start()
    q.awaitTermination()
    return q


def _stream_str09(spark, sf_dir):
    """STR-09: semgrep counts per scan arrive as a stream (one file per
    micro-batch) and are merged into the stored severity summary with
    ``foreachBatch`` (AGG-09 + SNK-05 upsert by scan)."""
    import uuid
    from codelens.operators import score as S
    f = V.v_findings(spark, sf_dir)
    run = _scratch(spark, sf_dir, f"str09-{uuid.uuid4().hex[:8]}")
    target, src = f"{run}/summary", f"{run}/incoming"
    stored = S.severity_summary(f.filter(F.col("kind") == S.VULN))
    stored.write.mode("overwrite").partitionBy("scan_id").parquet(target)
    counts = S.tool_rollup(f).filter(F.col("tool") == "semgrep").select("scan_id", "high", "medium", "low")
    counts.repartition(3, "scan_id").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    _run_available_now(stream, "append", None, f"{run}/ckpt", P.merge_findings_batch(target))
    return spark.read.parquet(target).select("scan_id", "low", "moderate", "high", "critical", "unknown")


register("STR-09", MERGE_SQL)(_stream_str09)


@register("STR-11", None)
def q_str11(spark, sf_dir):
    """STR-11: code-corpus files arrive as a stream; the stateless detectors
    run unchanged on it (append mode); the findings go to files, not to the
    driver."""
    import uuid
    run = _scratch(spark, sf_dir, f"str11-{uuid.uuid4().hex[:8]}")
    V.v_code(spark, sf_dir).select("scan_id", "path", "size", "content").repartition(4).write.mode(
        "overwrite").parquet(f"{run}/corpus")
    found = P.detect_stream(spark, f"{run}/corpus")
    _run_available_now(found, "append", f"{run}/features", f"{run}/ckpt")
    return spark.read.schema(found.schema).parquet(f"{run}/features")


def _quota_sql(key: str, max_requests: int, window_ms: int, skip: list[str]) -> str:
    """Sequential first-request-anchored fold per key as a recursive CTE
    (one step per request of a key, in (ts, seq) order)."""
    cond = " AND ".join(f"NOT starts_with(path, '{p}')" for p in skip) or "true"
    return f"""
WITH RECURSIVE r0 AS (
  SELECT {key} AS key, ts, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq) AS rn
  FROM ({V.V_REQUESTS_SQL}) WHERE {cond}),
f(key, rn, ts, t, reset_ms, cnt) AS (
  SELECT key, rn, ts, t, t + {window_ms}, 1 FROM r0 WHERE rn = 1
  UNION ALL
  SELECT r0.key, r0.rn, r0.ts, r0.t,
         CASE WHEN r0.t >= f.reset_ms THEN r0.t + {window_ms} ELSE f.reset_ms END,
         CASE WHEN r0.t >= f.reset_ms THEN 1 ELSE f.cnt + 1 END
  FROM f JOIN r0 ON r0.key = f.key AND r0.rn = f.rn + 1)
SELECT key, ts, CAST(cnt AS BIGINT) AS count, CAST(greatest(0, {max_requests} - cnt) AS BIGINT) AS remaining,
       cnt > {max_requests} AS limited, epoch_ms(reset_ms) AS reset_ts
FROM f
"""


ORACLE["STR-06"] = _quota_sql("ip", 60, 60_000, ["/socket.io", "/api/browsers"])
ORACLE["STR-07"] = _quota_sql("tenant", 10, 60_000, [])


def _str11_sql():
    from codelens.plans.q_detect import CORPUS, DET01_SQL, DET02_SQL
    code = f"({V.V_CODE_SQL})"
    return (f"SELECT scan_id, file, feature FROM ({DET01_SQL.replace(CORPUS, code)}) "
            f"UNION ALL SELECT scan_id, file, feature FROM ({DET02_SQL.replace(CORPUS, code)})")


ORACLE["STR-11"] = _str11_sql()
