"""Sorts, limits and top-k (TOP-*).

Per-scan top-k is ``row_number() <= k`` over ``partitionBy(scan_id)``: Spark
plans it with a ``WindowGroupLimit`` on both sides of the shuffle, so each map
task keeps at most k rows per scan before anything moves, and a hot scan never
ships more than k rows per input partition.  Every ordering carries a
deterministic tie-break column (JavaScript sorts are stable by input order; we
order ties by an explicit key instead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions.severity import severity_rank3, severity_weight


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None,
          rank_col: str | None = "rank") -> DataFrame:
    """Generic per-group top-k with a 1-based rank column."""
    by = by or []
    if not by:  # one list: every task keeps its k best, then k rows are numbered
        df = df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def top_impacted(impact: DataFrame, k: int = 15) -> DataFrame:
    """TOP-01: top k files by impact score per scan (ties by file)."""
    return top_k(impact, k, [F.col("score").desc(), F.col("file").asc()], by=["scan_id"])


def top_findings(findings: DataFrame, k: int = 50, ord_col: str = "ord") -> DataFrame:
    """TOP-02: top k findings per scan by severity weight
    (critical 4, high 3, medium 2, low 1, else 0), stable by ``ord_col``."""
    f = findings.withColumn("weight", severity_weight(F.col("severity")))
    return top_k(f, k, [F.col("weight").desc(), F.col(ord_col).asc()], by=["scan_id"])


def latest_scans(scans: DataFrame, k: int = 20) -> DataFrame:
    """TOP-03: the k most recent scans (TakeOrderedAndProject; ties by id)."""
    return scans.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(k)


def page(df: DataFrame, n: int, size: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """TOP-05: page ``n`` (1-based) of ``size`` rows per group, plus
    ``total_pages = max(1, ceil(count / size))``.

    Rows up to the page's end are a rank filter (``WindowGroupLimit`` keeps at
    most ``n x size`` rows per group and map task before the shuffle); the
    count is a grouped aggregate joined back, not a window over a whole group."""
    keys = list(by or [])
    if not keys:  # one list: a constant group key (equi join on it, no cross join)
        df, keys = df.withColumn("_g", F.lit(0)), ["_g"]
    lo, hi = (n - 1) * size + 1, n * size
    w = Window.partitionBy(*keys).orderBy(*order)
    head = df.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= hi).filter(F.col("row") >= lo)
    counts = df.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(size))).cast("long").alias("total_pages"))
    out = head.join(counts, keys, "inner")
    return out.drop("_g") if "_g" in keys else out


def first_results(findings: DataFrame, k: int = 100, ord_col: str = "ord") -> DataFrame:
    """TOP-06: first k tool results per (scan, tool) in input order."""
    return top_k(findings, k, [F.col(ord_col).asc()], by=["scan_id", "source"], rank_col=None)


def largest_files(files: DataFrame, k: int = 10) -> DataFrame:
    """TOP-07: k largest files per scan by bytes (not by formatted text),
    with a human-readable size."""
    f = files.withColumn("human_size", human_size(F.col("size")))
    return top_k(f, k, [F.col("size").desc(), F.col("path").asc()], by=["scan_id"])


def human_size(b: Column) -> Column:
    """Bytes as ``<n> B`` below 1 KiB, else KB / MB / GB (dividing by 1024
    while at least 1024, GB at most) with one decimal rounded half up and no
    digit grouping.  The tenths are an exact integer (``floor(x*10 + 0.5)``)."""
    b = b.cast("double")

    def tenths(div):
        n = F.floor(b / F.lit(float(div)) * 10 + 0.5).cast("long")
        return F.concat((n / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))
    return (F.when(b.isNull(), F.lit(""))
            .when(b < 1024, F.concat(b.cast("long").cast("string"), F.lit(" B")))
            .when(b < 1024 ** 2, F.concat(tenths(1024), F.lit(" KB")))
            .when(b < 1024 ** 3, F.concat(tenths(1024 ** 2), F.lit(" MB")))
            .otherwise(F.concat(tenths(1024 ** 3), F.lit(" GB"))))


def sort_issues(findings: DataFrame, severities: list[str] | None = None) -> DataFrame:
    """TOP-08: keep chosen severities (case-insensitive), weight High 3 /
    Medium 2 / else 1, sorted by weight desc; ties keep the list order
    (``list_ord``, ``ord`` when present — the original sort is stable).  The
    sort is a range-partitioned global order, not a collect."""
    f = findings
    if severities:
        f = f.filter(F.lower(F.col("severity")).isin(*[s.lower() for s in severities]))
    f = f.withColumn("weight", severity_rank3(F.col("severity")))
    ties = [F.col(c).asc() for c in ("list_ord", "ord") if c in f.columns]
    return f.orderBy(F.col("weight").desc(), *ties)


def file_features(features: DataFrame, k: int = 40) -> DataFrame:
    """TOP-09: per-file sorted feature list joined by ', ', first k files
    alphabetically per scan."""
    per_file = features.groupBy("scan_id", "file").agg(
        F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("features"),
        F.count_distinct("feature").alias("n_features"))
    return top_k(per_file, k, [F.col("file").asc()], by=["scan_id"], rank_col=None)
