"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

The generator and jump rule are those of Lamping and Veach ("A Fast, Minimal
Memory, Consistent Hash Algorithm"): shard ``n`` takes exactly the keys whose
jump sequence lands on it, so growing from ``n`` to ``n + 1`` shards moves
about ``1 / (n + 1)`` of the keys, all of them into the new shard, and no ring
table exists anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the 64-bit linear congruential multiplier of the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
_MASK = 0xFFFFFFFF
BLOCK_BITS = 12


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _product32(x: Column, y: int) -> Column:
    """Low 32 bits of ``x * y`` for 32-bit ``x`` and ``y``; nothing exceeds 2^49."""
    upper = F.shiftright(x, 16) * _long(y)
    return ((x.bitwiseAND(_long(0xFFFF)) * _long(y))
            + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16)).bitwiseAND(_long(_MASK))


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """``state * MULTIPLIER + 1`` modulo 2^64 on 32-bit halves, so that ANSI
    arithmetic never overflows."""
    t0 = low.bitwiseAND(_long(0xFFFF)) * _long(_LOW)
    t1 = F.shiftright(low, 16) * _long(_LOW)
    s = t0 + F.shiftleft(t1.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(s, 32) + F.shiftright(t1, 16)
    new_high = (carry + _product32(high, _LOW) + _product32(low, _HIGH)).bitwiseAND(_long(_MASK))
    return new_high, s.bitwiseAND(_long(_MASK))


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(_long(_MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, 0 .. shards-1) of a long ``key``; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), _long(0))
    high, low = _halves(key)
    start = F.struct(_long(-1).alias("b"), _long(0).alias("j"), high.alias("high"), low.alias("low"))

    def jump(acc: Column, _i: Column) -> Column:
        new_high, new_low = _next_state(acc["high"], acc["low"])
        nxt = ((acc["j"] + _long(1)).cast("double")
               * (F.lit(2147483648.0) / (F.shiftright(new_high, 1) + _long(1)).cast("double"))).cast("long")
        return F.when(acc["j"] < shards, F.struct(acc["j"].alias("b"), nxt.alias("j"),
                                                  new_high.alias("high"), new_low.alias("low"))).otherwise(acc)

    # every jump goes forward, so `shards` steps always suffice; finished rows pass through
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda acc: acc["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", column: str = "shard",
                  grown_column: str | None = "grown_shard") -> DataFrame:
    """Add ``column`` (shard under ``shards`` shards) and, if named,
    ``grown_column`` (shard under one more).  A projection: no shuffle, every
    other column passes through; columns of these names are replaced."""
    out = docs.withColumn(column, jump_hash(F.col(key), shards))
    return out.withColumn(grown_column, jump_hash(F.col(key), shards + 1)) if grown_column else out


def shard_slots(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard and a gapless ``slot`` in it.

    Returns (``key``, size, text_crc32, law, shard, slot, grown_shard).  Size is
    the UTF-8 length plus 1; a null text counts as empty.  Equal rows (same key,
    size and checksum) are counted before any shuffle; a shard is numbered block
    by block (4096 blocks by key hash), so no task holds a whole shard; repeated
    rows get slots of their own.  A null key goes to the shard of key 0.  An
    empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    k = F.coalesce(F.col(key).cast("long"), _long(0))
    block = F.shiftright(_next_state(*_halves(k))[0], 32 - BLOCK_BITS).cast("int")
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), block.alias("block"))
    counted = rows.groupBy("k", "size", "text_crc32", "block").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns({"shard": jump_hash(F.col("k"), shards),
                                   "grown_shard": jump_hash(F.col("k"), shards + 1)})
    # at most shards x 4096 rows, whatever the input
    blocks = counted.groupBy("shard", "block").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("rows").over(before), _long(0)).alias("block_start"))
    within = (Window.partitionBy("shard", "block").orderBy(F.col("k").asc_nulls_first(), "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (counted.withColumn("start", F.coalesce(F.sum("n").over(within), _long(0)))
              .join(blocks, ["shard", "block"]))
    # copies come out in two steps, so that a huge group never builds one huge array
    span = 65536
    wide = (placed.withColumn("part", F.explode(F.sequence(_long(0), F.floor((F.col("n") - 1) / span))))
            .withColumn("copy", F.explode(F.sequence(F.col("part") * span,
                                                     F.least(F.col("n"), (F.col("part") + 1) * span) - 1))))
    return wide.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                       (F.col("block_start") + F.col("start") + F.col("copy")).alias("slot"), "grown_shard")
