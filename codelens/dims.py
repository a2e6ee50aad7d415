"""Small dimension tables built from the fixed rule lists.

Each dim is a literal DataFrame whose row count is bounded by a list in
``codelens.rules`` (never by the data), so broadcasting it is always safe.
User-supplied dims go through ``bounded_broadcast`` which only hints a
broadcast when the plan's size estimate is under the threshold; otherwise the
join is left to Catalyst/AQE (shuffle hash or sort-merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens import rules
from codelens.session import ensure_checkpoint_dir

BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def literal_dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast-hinted literal table; its size is the length of ``rows``."""
    return F.broadcast(spark.createDataFrame(rows, schema=schema))


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only when the optimizer's size estimate is bounded.

    The estimate comes from the optimized plan's statistics (file sizes for
    scans, row counts for literals); no job is run.
    """
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        if int(str(size)) <= max_bytes:
            return F.broadcast(df)
    except Exception:  # statistics unavailable -> let Catalyst decide
        pass
    return df


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES // 4, max_rows: int = 1_000_000) -> DataFrame:
    """``df``, computed once, with a broadcast hint if its rows, measured as JSON
    text, have at most ``max_bytes`` together; else the join is left to Spark."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def feature_dim(spark: SparkSession) -> DataFrame:
    """Long-form feature dimension ``(feature, browser, support, source, notes)``.

    A single status is replicated over the four browsers.
    """
    rows = [(f, b, s, "mapping", "") for f, s in rules.FEATURE_STATUS.items() for b in rules.BROWSERS]
    return literal_dim(spark, rows, "feature string, browser string, support string, source string, notes string")


def compat_aliases(spark: SparkSession) -> DataFrame:
    rows = list(rules.COMPAT_ALIASES.items())
    return literal_dim(spark, rows, "feature string, path string")


def tech_dim(spark: SparkSession) -> DataFrame:
    return literal_dim(spark, rules.TECH_EVALUATION, "name string, approved boolean, status string, testing_level string")


def sql_text(v: str | None) -> str:
    """A string (or null) as a literal of Spark SQL."""
    if v is None:
        return "CAST(NULL AS STRING)"
    # "${" would be read as a variable of the session
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("${", "\\u0024{") + "'"


def literal_array(values: list[str]) -> Column:
    """An array of strings, parsed at once: the time to build a plan is that of
    the calls into the JVM, and a column per literal is three of them."""
    return F.expr("array(" + ", ".join(map(sql_text, values)) + ")")
