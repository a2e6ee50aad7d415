"""Ordered running aggregates that do not put a whole group in one task.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task;
with one scan holding a third of all rows that task sorts a third of the data.
``running_sum`` computes the same running sum (and, with value 1, the 1-based
row index) in two passes:

1. range-partition by ``(key, order)`` and sort within partitions — a hot key
   is spread over many contiguous partitions;
2. ``mapInPandas`` folds each partition in order (one Arrow chunk at a time)
   into a partition-local running sum per key;
3. per (partition, key) totals form a small table (at most partitions x keys
   per partition rows); an exclusive prefix sum over partition ids per key
   gives each partition's offset, which is joined back.

The order must be total (add a tie-break column) for results to be
deterministic.  The folded partitions are written once to the shared checkpoint
folder, and both branches (the totals and the rows) read that copy, so they see
the same partitions whatever Spark samples, reuses or recomputes.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.session import ensure_checkpoint_dir


def _local_cumsum(by: list[str]):
    def fn(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carry = None, 0
        for pdf in chunks:
            if pdf.empty:
                continue
            local = pdf.groupby(by, sort=False, dropna=False)["_v"].cumsum()
            first = pdf[by].iloc[0]
            if last is not None and first.equals(last):  # the previous chunk's last key goes on
                same = pdf[by].eq(first) | (pdf[by].isna() & first.isna())
                local = local + same.all(axis=1) * carry
            last = pdf[by].iloc[-1]
            carry = local.iloc[-1]
            yield pdf.assign(_local=local.values)
    return fn


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column | None = None,
                out: str = "running", num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` (default 1 -> row index) within ``by``,
    ordered by ``order`` ascending (prefix the column name with '-' for
    descending), inclusive of the current row.  Integral values are summed as
    longs; rows with a null key form a group of their own."""
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = list(by) + [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tmp = df.withColumn("_v", value if value is not None else F.lit(1))
    kind = T.LongType() if isinstance(tmp.schema["_v"].dataType, T.IntegralType) else T.DoubleType()
    ranged = (tmp.withColumn("_v", F.coalesce(F.col("_v").cast(kind), F.lit(0).cast(kind)))
              .repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols).withColumn("_pid", F.spark_partition_id()))
    local = ranged.mapInPandas(_local_cumsum(by), T.StructType(ranged.schema.fields + [T.StructField("_local", kind)]))
    local = local.checkpoint(eager=True)
    totals = local.groupBy("_pid", *by).agg(F.sum("_v").alias("_tot"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)],
                            F.coalesce(F.sum("_tot").over(w), F.lit(0).cast(kind)).alias("_off"))
    match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(by)], F.col("_pid") == F.col("_opid"))
    j = local.join(offsets, match)
    return j.withColumn(out, F.col("_off") + F.col("_local")).select(*df.columns, out)


def row_index(df: DataFrame, by: list[str], order: list[str], out: str = "row") -> DataFrame:
    """1-based position of each row within ``by`` in ``order`` (row_number)."""
    return running_sum(df, by, order, None, out).withColumn(out, F.col(out).cast("long"))
