"""Intermediate results in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codelens.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder.  The copy
    survives lost executors and is read instead of being computed again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` once, bucketed by ``key``, as a table in the shared folder.

    Later joins and co-groups on ``key`` read the table in place: only their
    other, slim side is shuffled.  ``drop_tables`` removes what a session made.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"llm_{uuid.uuid4().hex}"
    path = spark.sparkContext.getCheckpointDir().rstrip("/") + f"/{name}"
    (df.repartition(buckets, key).write.format("parquet").option("compression", "none")
       .bucketBy(buckets, key).option("path", path).saveAsTable(name))
    return spark.table(name)


def drop_tables(spark: SparkSession) -> None:
    """Forget the tables that ``bucketed`` registered (their files go with the
    checkpoint folder)."""
    for t in spark.catalog.listTables():
        if t.name.startswith("llm_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def few(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows: the check before a broadcast."""
    return df.limit(limit + 1).count() <= limit


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` starts with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name
