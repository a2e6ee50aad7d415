"""Scan-to-scan comparison (JOIN-07..11, JOIN-19, AGG-25) and set operations
(SET-01..05).

Comparisons are written as one grouped aggregate over the union of both
snapshots keyed by ``(file, feature)`` (or by name), instead of a full outer
join: a single shuffle with map-side combine, robust to a hot file, and the
same plan serves added / removed / changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshots(baseline: DataFrame, scans: list[str]) -> DataFrame:
    """One row per (file, feature) seen in any of ``scans`` (up to 63): ``present``
    with a bit per scan, in their order, and ``statuses`` with the first status in
    each (by ``ord`` if present; null where absent).

    Any two of the scans are compared from this frame (``pair``): the table is read
    and shuffled once for all of them."""
    if len(scans) > 63:
        raise ValueError("a row has bits for 63 scans")
    order_key = F.col("ord") if "ord" in baseline.columns else F.lit(0)
    st = F.coalesce(F.col("status"), F.lit("unknown")) if "status" in baseline.columns else F.lit("unknown")
    bit, statuses = F.lit(0).cast("long"), []
    for i, scan in enumerate(scans):
        mine = F.col("scan_id") == scan
        bit = F.when(mine, F.lit(1 << i).cast("long")).otherwise(bit)
        statuses.append(F.min_by(F.when(mine, st), F.when(mine, order_key)))
    return baseline.filter(F.col("scan_id").isin(list(scans))).groupBy("file", "feature").agg(
        F.bit_or(bit).alias("present"), F.array(*statuses).alias("statuses"))


def pair(frame: DataFrame, scans: list[str], a: str, b: str) -> DataFrame:
    """(file, feature, in_a, in_b, status_a, status_b) of two scans of a ``snapshots`` frame."""
    i, j = scans.index(a), scans.index(b)

    def bit(k):
        return F.shiftright("present", k).bitwiseAND(F.lit(1).cast("long")).cast("int")

    return frame.select("file", "feature", bit(i).alias("in_a"), bit(j).alias("in_b"), F.element_at("statuses", i + 1).alias("status_a"),
                        F.element_at("statuses", j + 1).alias("status_b")).filter((F.col("in_a") == 1) | (F.col("in_b") == 1))


def pair_features(baseline: DataFrame, a: str, b: str) -> DataFrame:
    """One row per (file, feature) seen in scan ``a`` or ``b`` with presence
    flags and the first status in each snapshot (by ``ord`` if present)."""
    scans = list(dict.fromkeys([a, b]))
    return pair(snapshots(baseline, scans), scans, a, b)


def diff_features(features: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN-07: ``(file, feature, change)`` with change ``added`` (in b only)
    or ``removed`` (in a only)."""
    p = pair_features(features, a, b)
    return p.filter(F.col("in_a") != F.col("in_b")).select(
        "file", "feature", F.when(F.col("in_b") == 1, "added").otherwise("removed").alias("change"))


def diff_status(baseline: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN-08: features present in both snapshots whose status changed."""
    p = pair_features(baseline, a, b)
    sa = F.coalesce("status_a", F.lit("unknown"))
    sb = F.coalesce("status_b", F.lit("unknown"))
    return p.filter((F.col("in_a") == 1) & (F.col("in_b") == 1) & (sa != sb)).select(
        "file", "feature", sa.alias("from_status"), sb.alias("to_status"))


def suggestion_key():
    return F.coalesce(F.col("id"), F.concat_ws(":", F.col("file"), F.col("title")))


def diff_suggestions(suggestions: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN-09: suggestions of b whose key (id, else ``file:title``) is not in
    a (added) and of a not in b (removed); two left-anti joins on the key."""
    s = suggestions.withColumn("key", suggestion_key())
    sa, sb = s.filter(F.col("scan_id") == a), s.filter(F.col("scan_id") == b)
    ka, kb = sa.select("key").distinct(), sb.select("key").distinct()
    added = sb.join(ka, "key", "left_anti").withColumn("change", F.lit("added"))
    removed = sa.join(kb, "key", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def diff_names(names: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN-10: per kind (frameworks / config files / build tools) names added
    in b and removed from a (set semantics)."""
    ab = names.filter(F.col("scan_id").isin(a, b))
    p = ab.groupBy("kind", "name").agg(
        F.max((F.col("scan_id") == a).cast("int")).alias("in_a"),
        F.max((F.col("scan_id") == b).cast("int")).alias("in_b"))
    return p.filter(F.col("in_a") != F.col("in_b")).select(
        "kind", "name", F.when(F.col("in_b") == 1, "added").otherwise("removed").alias("change"))


def diff_status_counts(baseline: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN-11: status-count delta b - a (supported, partial, unsupported, unknown)."""
    s = F.lower(F.coalesce(F.col("status"), F.lit("unknown")))
    in_a = (F.col("scan_id") == a).cast("int")
    in_b = (F.col("scan_id") == b).cast("int")
    ab = baseline.filter(F.col("scan_id").isin(a, b))

    def delta(cond):  # count in b minus count in a (0 when a == b)
        return F.sum(F.when(cond, in_b - in_a).otherwise(0)).cast("long")
    return ab.agg(
        delta(s == "supported").alias("supported"), delta(s == "partial").alias("partial"),
        delta(s == "unsupported").alias("unsupported"),
        delta(~s.isin("supported", "partial", "unsupported")).alias("unknown"))


def compare_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """JOIN-19: each distinct name with side ``left`` / ``both`` / ``right``."""
    u = (left.select("name", F.lit(1).alias("l"), F.lit(0).alias("r"))
         .unionByName(right.select("name", F.lit(0).alias("l"), F.lit(1).alias("r"))))
    g = u.groupBy("name").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return g.select("name", F.when((F.col("l") == 1) & (F.col("r") == 1), "both")
                    .when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def diff_summary(baseline: DataFrame, suggestions: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-25: files changed (files with a status change), features added,
    features removed, suggestions added, suggestions removed.

    Each table is read once: features by one ``snapshots`` frame, suggestions
    by their number per key in either scan.  Both give one row per file or key with
    its counts, and one global aggregate adds them up."""
    names = ["files_changed", "features_added", "features_removed", "suggestions_added", "suggestions_removed"]

    def counts(df: DataFrame, **given):
        return df.select(*[given.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    p = pair_features(baseline, a, b)
    both = (F.col("in_a") == 1) & (F.col("in_b") == 1)
    files = p.groupBy("file").agg(
        F.max((both & (F.coalesce("status_a", F.lit("unknown")) != F.coalesce("status_b", F.lit("unknown")))).cast("int")).alias("changed"),
        F.sum(F.when(F.col("in_a") == 0, 1).otherwise(0)).alias("added"), F.sum(F.when(F.col("in_b") == 0, 1).otherwise(0)).alias("removed"))
    # a null file is no file that changed
    files = counts(files, files_changed=F.when(F.col("file").isNotNull(), F.col("changed")).otherwise(0),
                   features_added=F.col("added"), features_removed=F.col("removed"))
    of = lambda scan: F.sum((F.col("scan_id") == scan).cast("int"))
    keys = suggestions.filter(F.col("scan_id").isin(a, b)).groupBy(suggestion_key().alias("key")).agg(of(a).alias("in_a"), of(b).alias("in_b"))
    keys = counts(keys, suggestions_added=F.when(F.col("in_a") == 0, F.col("in_b")).otherwise(0),
                  suggestions_removed=F.when(F.col("in_b") == 0, F.col("in_a")).otherwise(0))
    return files.unionByName(keys).agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names])


# -- set operations -----------------------------------------------------------

def union_findings(dfs: list[DataFrame], tags: list[str], tag_col: str = "tag") -> DataFrame:
    """SET-01: tagged bag union (columns matched by name)."""
    tagged = [d.withColumn(tag_col, F.lit(t)) for d, t in zip(dfs, tags)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def union_names(*dfs: DataFrame) -> DataFrame:
    """SET-02: distinct union."""
    return reduce(lambda x, y: x.unionByName(y), dfs).distinct()


def except_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-03: distinct rows of a not in b."""
    return a.subtract(b)


def common_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-04: distinct rows in both."""
    return a.intersect(b)


def append_findings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """SET-05: bag union of stored and new findings."""
    return stored.unionByName(new, allowMissingColumns=True)
