"""First-request-anchored quotas over keys of any size.

A window of a key opens at a request and closes ``window_ms`` later; the first
request at or after that opens the next one.  The fold is sequential per key,
but it can be cut anywhere: what a run of requests does to the state before it
is known without that state.  Requests are range-partitioned by (key, time), so
a hot key lies in many partitions, and

1. every partition that one key fills as a whole is summed up as a step function from the
   time at which the open window closes to the window that is open at the
   partition's end.  Chains of windows that start at different requests meet soon; a
   step function has at most one step per millisecond of a window;
2. one small task walks over the partitions, one line each, and applies them;
3. every partition folds its own requests from the state that it is entered with.

Equal (key, time) pairs are counted before the shuffle and numbered at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.session import ensure_checkpoint_dir

_SUMMARY = ("pid int, first string, last string, total long, end_ms long, whole boolean, reset_ms long, count long, "
            "until array<long>, resets array<long>, counts array<long>")


def _read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def _segments(table: pa.Table) -> np.ndarray:
    """Index of the key of each row, in the order of the rows."""
    codes = table.column("key").combine_chunks().dictionary_encode()
    return (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy().astype(np.int64)


def next_opening(keys: np.ndarray, ms: np.ndarray, window_ms: int) -> np.ndarray:
    """Per row the first row that no longer lies in a window which opens at it: the
    next one of its key at least ``window_ms`` later, or the first of the next key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    if len(starts) < 64 or (len(starts) + 1) * float(ms.max() - ms.min() + window_ms + 1) > 2.0**62:
        return np.concatenate([a + np.searchsorted(ms[a:b], ms[a:b] + window_ms) for a, b in zip(starts, ends)])
    # keys one behind the other on one time line
    place = np.repeat(np.arange(len(starts)), ends - starts) * (ms.max() - ms.min() + window_ms + 1) + (ms - ms.min())
    return np.minimum(np.searchsorted(place, place + window_ms), np.repeat(ends, ends - starts))


def last_opening(following: np.ndarray) -> np.ndarray:
    """Per row the last opening of the chain of windows that begins at it."""
    n = len(following)
    at = np.where(following < n, following, np.arange(n))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def _sum_up(window_ms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _read(batches)
        if table is None:
            return
        keys, ms, n = _segments(table), table.column("ms").to_numpy(), table.column("n").to_numpy()
        start = int(np.searchsorted(keys, keys[-1])) if keys[-1] else 0
        ms, n = ms[start:], n[start:]  # the last key's requests
        final = last_opening(next_opening(np.zeros(len(ms), np.int64), ms, window_ms))
        behind = np.cumsum(n[::-1])[::-1]
        whole = start == 0
        # entered with a window that closes at r, the first opening is the first request at or after r;
        # r is at most one window after the first request
        entries = int(np.searchsorted(ms, ms[0] + window_ms, side="right")) if whole else 1
        entries = max(1, min(entries + 1, len(ms)))
        steps = np.flatnonzero(np.concatenate((final[1:entries] != final[:entries - 1], [True])))
        at = final[steps]
        column = table.column("key")
        yield pa.RecordBatch.from_pydict(
            {"pid": [table.column("pid")[0].as_py()], "first": [column[0].as_py()], "last": [column[len(column) - 1].as_py()],
             "total": [int(n.sum())], "end_ms": [int(ms[-1])], "whole": [whole], "reset_ms": [int(ms[final[0]] + window_ms)],
             "count": [int(behind[final[0]])], "until": [ms[steps].tolist()], "resets": [(ms[at] + window_ms).tolist()], "counts": [behind[at].tolist()]},
            schema=pa.schema([("pid", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("total", pa.int64()), ("end_ms", pa.int64()),
                              ("whole", pa.bool_()), ("reset_ms", pa.int64()), ("count", pa.int64()), ("until", pa.list_(pa.int64())),
                              ("resets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))
    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries in partition order -> (pid, reset_ms, count): the state that each partition is entered with."""
    key = reset = None
    count = 0
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            entered = (reset, count) if key is not None and s["first"] == key else None
            out.append((s["pid"], *(entered or (None, 0))))
            if entered is None or not s["whole"]:
                reset, count = s["reset_ms"], s["count"]
            elif reset > s["end_ms"]:  # the window stays open throughout
                count += s["total"]
            else:
                i = int(np.searchsorted(np.array(s["until"]), reset))
                reset, count = s["resets"][i], s["counts"][i]
            key = s["last"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["pid", "reset_ms", "count"])


def _fold(entered: dict[int, tuple[int | None, int]], window_ms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _read(batches)
        if table is None:
            return
        keys, ms, n = _segments(table), table.column("ms").to_numpy(), table.column("n").to_numpy()
        reset, count = entered[table.column("pid")[0].as_py()]
        following = next_opening(keys, ms, window_ms)
        first_end = int(np.searchsorted(keys, 0, side="right"))
        at = 0 if reset is None else int(np.searchsorted(ms[:first_end], reset))
        opens, hops = [], following.tolist()
        while at < len(hops):
            opens.append(at)
            at = hops[at]
        starts = np.array(opens, np.int64)
        window = np.searchsorted(starts, np.arange(len(ms)), side="right") - 1  # -1: still in the window before
        before = np.cumsum(n) - n
        base, closes = np.full(len(ms), count, np.int64), np.full(len(ms), reset or 0, np.int64)
        inside = window >= 0
        base[inside] = -before[starts[window[inside]]]
        closes[inside] = ms[starts[window[inside]]] + window_ms
        yield from pa.table({"key": table.column("key"), "ts": table.column("ts"), "n": table.column("n"), "before": pa.array(base + before),
                             "reset_ms": pa.array(closes)}).to_batches(max_chunksize=10_000)
    return run


def anchored_quota(requests: DataFrame, max_requests: int, window_ms: int) -> DataFrame:
    """(key, ts, count, remaining, limited, reset_ts) of requests (key, ts): the running
    count in the window that is open, which opened at a request of the key.

    Requests at the same time count one after the other.  A null key is a key of its
    own; rows without a time are left out.  The driver gets one state per partition.
    """
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = F.coalesce(F.concat(F.lit("="), F.col("key")), F.lit("-"))  # no null among the keys
    counted = requests.where(F.col("ts").isNotNull()).groupBy(tagged.alias("key"), "ts").agg(F.count(F.lit(1)).alias("n"))
    rows = (counted.withColumn("ms", F.unix_millis("ts")).repartitionByRange(parts, "key", "ts").sortWithinPartitions("key", "ts")
            .withColumn("pid", F.spark_partition_id()).checkpoint(eager=True))  # fixed before it is read twice
    summaries = rows.mapInArrow(_sum_up(window_ms), _SUMMARY)
    states = summaries.repartition(1).sortWithinPartitions("pid").mapInArrow(_walk, "pid int, reset_ms long, count long").collect()
    entered = {r["pid"]: (r["reset_ms"], r["count"]) for r in states}
    folded = rows.mapInArrow(_fold(entered, window_ms), "key string, ts timestamp, n long, before long, reset_ms long")
    # a burst of equal times comes out in two steps, so that it never is one huge array
    span = F.lit(65536).cast("long")
    wide = folded.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / span))))
    wide = wide.withColumn("nth", F.explode(F.sequence(F.col("part") * span + 1, F.least(F.col("n"), (F.col("part") + 1) * span))))
    count = F.col("before") + F.col("nth")
    return wide.select(F.when(F.col("key") != "-", F.substring("key", 2, 2**31 - 1)).alias("key"), "ts", count.alias("count"),
                       F.greatest(F.lit(0).cast("long"), F.lit(max_requests) - count).alias("remaining"),
                       (count > max_requests).alias("limited"), F.timestamp_millis("reset_ms").alias("reset_ts"))
