"""Aggregations and scores (AGG-*).

All aggregates group by ``scan_id`` (plus the operator's own keys), so Spark
runs a partial aggregate before the shuffle: a scan holding a third of all
rows contributes one partial row per map task, never its raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions.scalar import clamp, round_half_up
from codelens.functions.severity import normalize_severity, semgrep_severity, severity_bucket
from codelens.functions.status import impact_rank
from codelens.operators.baseline import support_map
from codelens.operators.topk import top_findings


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def impact_by_file(baseline: DataFrame) -> DataFrame:
    """AGG-13: per (scan, file) score = sum of impact ranks (unsupported 3,
    partial 2, anything else 1), unsupported count, partial count, total."""
    s = F.lower(F.coalesce(F.col("status"), F.lit("unknown")))
    return baseline.groupBy("scan_id", "file").agg(
        F.sum(impact_rank(F.col("status"))).cast("long").alias("score"),
        _count_if(s == "unsupported").alias("unsupported"),
        _count_if(s == "partial").alias("partial"),
        F.count(F.lit(1)).alias("total"),
    )


# --------------------------------------------------------------------------
# Findings kinds of the ``findings`` table (scan_id, kind, source, title,
# severity, file, description, ord).
VULN, INSECURE, POLICY, SECRET, CI = "vulnerability", "insecure_api", "missing_policy", "secret", "ci"


def _kind(findings: DataFrame, *kinds: str) -> DataFrame:
    return findings.filter(F.col("kind").isin(*kinds))


def severity_summary(vulns: DataFrame) -> DataFrame:
    """AGG-04: per scan low / moderate (= medium) / high / critical / unknown."""
    s = normalize_severity(F.col("severity"))
    return vulns.groupBy("scan_id").agg(
        _count_if(s == "low").alias("low"), _count_if(s == "medium").alias("moderate"),
        _count_if(s == "high").alias("high"), _count_if(s == "critical").alias("critical"),
        _count_if(s == "unknown").alias("unknown"))


def bucket_counts(df: DataFrame, by: list[str], default: str = "low") -> DataFrame:
    """Counts per four-level bucket (missing / unknown severity -> ``default``)."""
    b = severity_bucket(F.col("severity"), default)
    return df.groupBy(*by).agg(
        _count_if(b == "critical").alias("critical"), _count_if(b == "high").alias("high"),
        _count_if(b == "medium").alias("medium"), _count_if(b == "low").alias("low"))


def vuln_counts(vulns: DataFrame) -> DataFrame:
    """AGG-05: Critical / High / Medium / Low per scan, missing severity -> Low."""
    return bucket_counts(vulns, ["scan_id"])


def hygiene_issues(findings: DataFrame) -> DataFrame:
    """Missing policies then insecure calls (the hygiene list, SET-01 tagged)."""
    return _kind(findings, POLICY, INSECURE).withColumn(
        "list_ord", F.when(F.col("kind") == POLICY, 0).otherwise(1))


def hygiene_counts(findings: DataFrame) -> DataFrame:
    """AGG-06: severity counts over insecure calls + missing policies."""
    return bucket_counts(hygiene_issues(findings), ["scan_id"])


SECRET_TEXT = r"(?i)(secret|credential|token|key)"


def secret_items(findings: DataFrame) -> DataFrame:
    """Secrets plus vulnerabilities whose title (else description) names a secret."""
    text = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("description"), F.lit(""))
    return findings.filter((F.col("kind") == SECRET) | ((F.col("kind") == VULN) & text.rlike(SECRET_TEXT)))


def secret_counts(findings: DataFrame) -> DataFrame:
    """AGG-07: severity counts and total over secrets + secret-like vulnerabilities."""
    return bucket_counts(secret_items(findings), ["scan_id"]).withColumn(
        "total", F.col("critical") + F.col("high") + F.col("medium") + F.col("low"))


def tool_rollup(findings: DataFrame) -> DataFrame:
    """AGG-08: per (scan, tool) findings count and High / Medium / Low by the
    tool-output severity mapping."""
    s = semgrep_severity(F.col("severity"))
    return findings.groupBy("scan_id", F.col("source").alias("tool")).agg(
        F.count(F.lit(1)).alias("findings"), _count_if(s == "High").alias("high"),
        _count_if(s == "Medium").alias("medium"), _count_if(s == "Low").alias("low"))


def merge_severity(stored: DataFrame, new: DataFrame) -> DataFrame:
    """AGG-09: add tool counts (High -> high, Medium -> moderate, Low -> low)
    into a stored severity summary; union of partial rows then one sum."""
    cols = ["low", "moderate", "high", "critical", "unknown"]
    a = stored.select("scan_id", *[F.col(c).cast("long").alias(c) for c in cols])
    b = new.select("scan_id", F.col("low").cast("long").alias("low"), F.col("medium").cast("long").alias("moderate"),
                   F.col("high").cast("long").alias("high"), F.lit(0).cast("long").alias("critical"),
                   F.lit(0).cast("long").alias("unknown"))
    return a.unionByName(b).groupBy("scan_id").agg(*[F.sum(c).cast("long").alias(c) for c in cols])


def status_counts(baseline: DataFrame) -> DataFrame:
    """AGG-10: supported / partial / unsupported / unknown entries per scan."""
    s = F.lower(F.coalesce(F.col("status"), F.lit("unknown")))
    return baseline.groupBy("scan_id").agg(
        _count_if(s == "supported").alias("supported"), _count_if(s == "partial").alias("partial"),
        _count_if(s == "unsupported").alias("unsupported"),
        _count_if(~s.isin("supported", "partial", "unsupported")).alias("unknown"))


def project_features(features: DataFrame) -> DataFrame:
    """DET-03 as rows: distinct (scan_id, feature)."""
    return features.select("scan_id", "feature").filter(F.col("feature").isNotNull()).distinct()


def compat_classes(features: DataFrame, feature_dim: DataFrame) -> DataFrame:
    """AGG-11 rows: each distinct project feature with its mapped status
    (unmapped -> unknown)."""
    from codelens.operators.baseline import dim_by_feature
    from codelens.dims import bounded_broadcast
    dim = bounded_broadcast(dim_by_feature(feature_dim).select("feature", "status"))
    return project_features(features).join(dim, "feature", "left").select(
        "scan_id", "feature", F.coalesce("status", F.lit("unknown")).alias("status"))


def compatibility(features: DataFrame, feature_dim: DataFrame, recommendations: DataFrame | None = None) -> DataFrame:
    """AGG-11: per scan counts and sorted lists of supported / partial /
    unsupported project features; with ``recommendations`` (AGG-12) also their
    number as ``suggested``."""
    c = compat_classes(features, feature_dim)
    s = F.col("status")

    def lst(word):
        return F.array_join(F.array_sort(F.collect_list(F.when(s == word, F.col("feature")))), ",")
    out = c.groupBy("scan_id").agg(
        _count_if(s == "supported").alias("supported"), _count_if(s == "partial").alias("partial"),
        _count_if(s == "unsupported").alias("unsupported"),
        lst("supported").alias("supported_features"), lst("partial").alias("partial_features"),
        lst("unsupported").alias("unsupported_features"))
    if recommendations is None:
        return out
    suggested = recommendations.groupBy("scan_id").agg(F.count(F.lit(1)).alias("suggested"))
    return out.join(suggested, "scan_id", "left").fillna(0, ["suggested"])


# FIXED VALUES: recommendation texts (AGG-12), in rule order.
RECOMMENDATIONS = [
    "Migrate XMLHttpRequest calls to fetch API",
    "Remove Promise polyfill; async/await is supported",
    "Use AbortController to cancel in-flight fetch requests",
    "Add Content Security Policy (CSP) via security middleware",
    "Enable express-rate-limit to throttle abusive traffic",
    "Add csurf middleware to protect against CSRF attacks",
    "Disable 'X-Powered-By' header via app.disable('x-powered-by')",
    "Restrict CORS origin to known domains and avoid credentials with wildcard",
    "Set httpOnly and secure flags on cookies (prefer secure in production)",
]
CORS_POLICY_TITLES = ["Permissive CORS", "Permissive CORS with credentials", "Wildcard CORS headers/methods"]
COOKIE_TITLES = ["Cookie without httpOnly", "Cookie without secure"]


def scan_flags(features: DataFrame, configs: DataFrame, findings: DataFrame,
               feature_dim: DataFrame) -> DataFrame:
    """Per-scan presence flags used by rule operators (one row per scan that
    appears in any input).  Each input is reduced to one row per scan before
    the joins, so the joins are per-scan small."""
    c = compat_classes(features, feature_dim)
    f = c.groupBy("scan_id").agg(
        *[F.max((F.col("feature") == n).cast("int")).alias(a) for n, a in
          [("XMLHttpRequest", "has_xhr"), ("fetch", "has_fetch"), ("AbortController", "has_abort"),
           ("core-js/features/promise", "has_promise_polyfill"), ("TypeScript", "has_ts"),
           ("eslint", "has_eslint"), ("webpack", "has_webpack")]],
        F.max(((F.col("feature") == "async-await") & (F.col("status") == "supported")).cast("int")).alias("aa_supported"),
        _count_if(F.col("status") == "unsupported").alias("unsupported"))
    cf = configs.groupBy("scan_id").agg(F.max((F.col("name") == "helmet.config.js").cast("int")).alias("has_helmet_cfg"))
    t = F.col("title")
    pol = F.col("kind") == POLICY
    ins = F.col("kind") == INSECURE
    fl = findings.groupBy("scan_id").agg(
        _count_if(pol).alias("policies"), _count_if(ins).alias("insecure"),
        F.max((pol & (t == "Rate limiting")).cast("int")).alias("t_rate"),
        F.max((pol & (t == "CSRF")).cast("int")).alias("t_csrf"),
        F.max((pol & (t == "X-Powered-By")).cast("int")).alias("t_xpb"),
        F.max((pol & t.isin(*CORS_POLICY_TITLES)).cast("int")).alias("t_cors"),
        F.max((ins & t.isin(*COOKIE_TITLES)).cast("int")).alias("t_cookie"))
    out = f.join(cf, "scan_id", "full").join(fl, "scan_id", "full")
    return out.fillna(0)


def recommendations(flags: DataFrame) -> DataFrame:
    """AGG-12: ``(scan_id, ord, recommendation)`` rows from the 9 rules."""
    g = F.col
    conds = [
        (g("has_xhr") == 1) & (g("has_fetch") == 0),
        (g("has_promise_polyfill") == 1) & (g("aa_supported") == 1),
        (g("has_fetch") == 1) & (g("has_abort") == 0),
        (g("policies") > 0) & (g("has_helmet_cfg") == 0),
        g("t_rate") == 1, g("t_csrf") == 1, g("t_xpb") == 1, g("t_cors") == 1, g("t_cookie") == 1,
    ]
    arr = F.array(*[F.when(c, F.struct(F.lit(i + 1).alias("ord"), F.lit(txt).alias("recommendation")))
                    for i, (c, txt) in enumerate(zip(conds, RECOMMENDATIONS))])
    return flags.select("scan_id", F.explode(F.array_compact(arr)).alias("r")).select(
        "scan_id", F.col("r.ord").alias("ord"), F.col("r.recommendation").alias("recommendation"))


def feature_usage(features: DataFrame) -> DataFrame:
    """AGG-14: files per feature per scan."""
    return features.groupBy("scan_id", "feature").agg(F.count_distinct("file").alias("files"))


KNOWN_CATEGORIES = ["secure", "modernize", "performance", "cleanup"]


def suggestion_categories(suggestions: DataFrame, mode: str = "known") -> DataFrame:
    """AGG-15: category counts per scan.

    ``known``: category must be one of secure/modernize/performance/cleanup,
    anything else counts as modernize.  ``buckets``: substring buckets of the
    lower category (secure -> security, modernize -> modernization,
    performance), anything else -> maintenance."""
    c = F.lower(F.coalesce(F.col("category"), F.lit("")))
    if mode == "known":
        cat = F.when(F.col("category").isin(*KNOWN_CATEGORIES), F.col("category")).otherwise("modernize")
        names = KNOWN_CATEGORIES
    else:
        cat = (F.when(c.contains("secure"), "security").when(c.contains("modernize"), "modernization")
               .when(c.contains("performance"), "performance").otherwise("maintenance"))
        names = ["security", "modernization", "performance", "maintenance"]
    return suggestions.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"),
                                              *[_count_if(cat == n).alias(n) for n in names])


def _sugg_sev_score(sev: Column) -> Column:
    s = F.lower(F.coalesce(sev, F.lit("")))
    return F.when(s.startswith("high"), 3).when(s.startswith("medium"), 2).when(s != "", 1).otherwise(0)


def percentage(n: Column, d: Column) -> Column:
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0)).otherwise(
        round_half_up(n.cast("double") / d * 100)).cast("long")


def suggestion_summary(suggestions: DataFrame, compat: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-16: distinct files, baseline compliance %, severity score,
    estimated improvement = min(40, round(sqrt(n)*5 + 2*score)), security
    findings (missing policies + insecure calls)."""
    s = suggestions.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct(F.coalesce("file", F.lit("∅"))).alias("unique_files"),
        F.sum(_sugg_sev_score(F.col("severity"))).cast("long").alias("severity_score"))
    fc = findings.groupBy("scan_id").agg(_count_if(F.col("kind").isin(POLICY, INSECURE)).alias("security_findings"))
    c = compat.select("scan_id", "supported", "partial", "unsupported")
    j = s.join(c, "scan_id", "left").join(fc, "scan_id", "left").fillna(0)
    total = F.col("supported") + F.col("partial") + F.col("unsupported")
    return j.select(
        "scan_id", "items", "unique_files", "severity_score",
        percentage(F.col("supported"), total).alias("baseline_compliance"),
        F.least(F.lit(40), round_half_up(F.sqrt(F.col("items")) * 5 + F.col("severity_score") * 2)).cast("long")
        .alias("estimated_improvement"),
        F.col("security_findings").cast("long").alias("security_findings"))


def impact_heatmap(suggestions: DataFrame) -> DataFrame:
    """AGG-17 + WIN-04: per (scan, file) count, score = sum of severity weight
    (high 3, medium 2, else 1) x category multiplier (secure 1.3, performance
    1.2, modernize 1.1, else 1.0), sorted categories and pct = round(score /
    max score of the scan x 100) clamped to 1..100.

    Scores are summed in exact tenths, so the result does not depend on the
    order of floating-point additions.  The per-scan maximum is an aggregate
    joined back on scan_id (one row per scan), not a window over a whole scan.
    """
    sev = F.lower(F.coalesce("severity", F.lit("")))
    w = F.when(sev.startswith("high"), 3).when(sev.startswith("medium"), 2).otherwise(1)
    cat = F.lower(F.coalesce("category", F.lit("")))
    m10 = (F.when(cat.contains("secure"), 13).when(cat.contains("performance"), 12)
           .when(cat.contains("modernize"), 11).otherwise(10))
    per_file = suggestions.groupBy("scan_id", F.coalesce(F.nullif("file", F.lit("")), F.lit("unknown")).alias("file")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(w * m10).cast("long").alias("score10"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return share_of_max(per_file, "score10", ["scan_id"]).select(
        "scan_id", "file", "count", (F.col("score10") / 10.0).alias("score"), "categories", "pct")


def share_of_max(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """WIN-04: ``pct = clamp(round(col / max(col) over group x 100), 1, 100)``
    (max of 0 treated as 1).  Max per group is a grouped aggregate joined back."""
    mx = df.groupBy(*by).agg(F.max(col).alias("_max"))
    j = df.join(mx, by, "inner")
    denom = F.when(F.coalesce(F.col("_max"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("_max"))
    pct = clamp(round_half_up(F.col(col).cast("double") / denom * 100), 1, 100).cast("long")
    return j.withColumn("pct", pct).drop("_max")


def ci_summary(findings: DataFrame) -> DataFrame:
    """AGG-23: CI workflow findings per scan: total, high, medium, low."""
    s = normalize_severity(F.col("severity"))
    return _kind(findings, CI).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("workflows"), _count_if(s.isin("critical", "high")).alias("high"),
        _count_if(s == "medium").alias("medium"), _count_if(s == "low").alias("low"))


def release_gate(severity: DataFrame, findings: DataFrame, allow_insecure: bool = False) -> DataFrame:
    """AGG-24: blocked when critical+high > 0 or any secret finding, unless
    ``allow_insecure``."""
    x = _kind(findings, SECRET).groupBy("scan_id").agg(F.count(F.lit(1)).alias("secrets"))
    j = severity.join(x, "scan_id", "left")
    ch = (F.col("critical") + F.col("high")).cast("long")
    sec = F.coalesce(F.col("secrets"), F.lit(0)).cast("long")
    blocked = ((ch > 0) | (sec > 0)) & F.lit(not allow_insecure)
    return j.select("scan_id", ch.alias("critical_high"), sec.alias("secrets"), blocked.alias("blocked"))


def hygiene_by_file(findings: DataFrame) -> DataFrame:
    """AGG-28: hygiene issues grouped by file (``General`` when none): count
    and the first most severe severity (``Low`` unless something outranks low)."""
    from codelens.functions.severity import severity_weight
    i = hygiene_issues(findings).withColumn("_w", severity_weight(F.col("severity")))
    key = F.struct(F.col("_w"), -F.col("list_ord"), -F.col("ord"))
    return i.groupBy("scan_id", F.coalesce("file", F.lit("General")).alias("file")).agg(
        F.count(F.lit(1)).alias("count"),
        F.when(F.max("_w") > 1, F.max_by("severity", key)).otherwise(F.lit("Low")).alias("max_severity"))


def compliance_pct(compat: DataFrame) -> DataFrame:
    """AGG-33: compliance % = round(supported / (supported+partial+unsupported)
    x 100); badge colour (>=80, >=60, >=40) and health band (>=80, >=50)."""
    total = F.col("supported") + F.col("partial") + F.col("unsupported")
    pct = percentage(F.col("supported"), total)
    return compat.select("scan_id", "supported", total.alias("total"), pct.alias("pct")).select(
        "*",
        F.when(F.col("pct") >= 80, "brightgreen").when(F.col("pct") >= 60, "yellow")
        .when(F.col("pct") >= 40, "orange").otherwise("red").alias("badge"),
        F.when(F.col("pct") >= 80, "good").when(F.col("pct") >= 50, "fair").otherwise("poor").alias("health"))


# --------------------------------------------------------------------------
# Repository statistics (AGG-01..03, AGG-29, AGG-30)

def repo_stats(files: DataFrame) -> DataFrame:
    """AGG-01: files, distinct non-root directories, lines (``split('\\n')``
    length, trailing empties kept) and bytes per scan."""
    lines = F.size(F.split(F.coalesce(F.col("content"), F.lit("")), "\n"))
    return files.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct(F.when(F.col("dir") != ".", F.col("dir"))).alias("folders"),
        F.sum(lines).cast("long").alias("lines"), F.sum("size").cast("long").alias("bytes"))


def language_histogram(files: DataFrame) -> DataFrame:
    """AGG-02: files per lower extension (blank skipped), ranked by count
    (ties by extension)."""
    from pyspark.sql import Window
    h = files.filter(F.col("ext") != "").groupBy("scan_id", "ext").agg(F.count(F.lit(1)).alias("files"))
    w = Window.partitionBy("scan_id").orderBy(F.col("files").desc(), F.col("ext"))
    return h.withColumn("rank", F.row_number().over(w).cast("long"))


def language_share(files: DataFrame) -> DataFrame:
    """AGG-03: bytes per extension and the rounded share of the scan's bytes."""
    b = files.filter(F.col("ext") != "").groupBy("scan_id", "ext").agg(F.sum("size").cast("long").alias("bytes"))
    tot = b.groupBy("scan_id").agg(F.sum("bytes").alias("_total"))
    return b.join(tot, "scan_id").select("scan_id", "ext", "bytes", percentage(F.col("bytes"), F.col("_total")).alias("pct"))


def file_tree(files: DataFrame, max_depth: int = 2, max_nodes: int = 300) -> DataFrame:
    """AGG-29: compact tree of each scan — directories down to ``max_depth``
    and one leaf per file under its (depth-limited) directory, created in path
    order until ``max_nodes`` nodes exist (the root counts as one).

    Node creation events are (creating path, step); a directory is created by
    its first file, so its event is the minimum over files.  The cap is a
    per-scan top-(max_nodes - 1) over events (WindowGroupLimit).  Output rows
    are ``(scan_id, parent, name, type, depth, sort_key)`` with dirs before
    files and names alphabetical within a parent."""
    parts = F.filter(F.split(F.regexp_replace("path", r"\\", "/"), "/+"), lambda x: x != "")
    f = files.select("scan_id", F.col("path").alias("src"), parts.alias("parts")).filter(F.size("parts") > 0)
    n = F.size("parts")
    ndirs = F.least(n - 1, F.lit(max_depth))
    dir_events = f.select("scan_id", "src", F.posexplode(F.slice("parts", 1, F.greatest(ndirs, F.lit(0)))).alias("step", "name"),
                          "parts").select(
        "scan_id", "src", "step", "name",
        F.array_join(F.slice("parts", 1, F.col("step")), "/").alias("parent"), F.lit("dir").alias("type"))
    dirs = dir_events.groupBy("scan_id", "parent", "name").agg(F.min(F.struct("src", "step")).alias("e")).select(
        "scan_id", "parent", "name", F.lit("dir").alias("type"), F.col("e.src").alias("src"), F.col("e.step").alias("step"))
    leaves = f.select("scan_id", F.array_join(F.slice("parts", 1, ndirs), "/").alias("parent"),
                      F.element_at("parts", -1).alias("name"), F.lit("file").alias("type"), "src",
                      ndirs.alias("step"))
    ev = dirs.unionByName(leaves)
    from pyspark.sql import Window
    w = Window.partitionBy("scan_id").orderBy("src", "step")
    kept = ev.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_nodes - 1)
    depth = F.when(F.col("parent") == "", 1).otherwise(F.size(F.split("parent", "/")) + 1)
    return kept.select("scan_id", "parent", "name", "type", depth.cast("long").alias("depth"),
                       F.concat(F.col("parent"), F.lit("\u0001"), F.when(F.col("type") == "dir", "0").otherwise("1"),
                                F.lower("name"), F.lit("\u0001"), F.col("name")).alias("sort_key"))


def commit_frequency(activity: DataFrame, contributors: DataFrame, weeks: int = 4) -> DataFrame:
    """AGG-30: rounded mean of the last ``weeks`` weekly totals per repo, and
    the distinct contributor count."""
    from pyspark.sql import Window
    w = Window.partitionBy("repo").orderBy(F.col("week").desc())
    recent = activity.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= weeks)
    a = recent.groupBy("repo").agg(round_half_up(F.avg(F.coalesce("total", F.lit(0)))).cast("long").alias("commits_per_week"))
    c = contributors.groupBy("repo").agg(F.count_distinct("login").alias("contributors"))
    return a.join(c, "repo", "full")


# --------------------------------------------------------------------------
# Composite scores (AGG-18..22, 26, 27, 32, 34).  Each input is reduced to a
# long table of (scan_id, measure, value) and folded by ONE grouped aggregate:
# no joins between per-source results, one shuffle, partial aggregation.

def _measures(*parts: DataFrame) -> DataFrame:
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _ms(df: DataFrame, **measures: Column) -> DataFrame:
    """All measures of one source in ONE pass: a per-scan partial aggregate
    (one row per scan and source), so a source is scanned once however many
    measures it feeds."""
    return df.groupBy("scan_id").agg(*[F.sum(v.cast("double")).alias(n) for n, v in measures.items()])


def _m(df: DataFrame, name: str, value: Column) -> DataFrame:
    return _ms(df, **{name: value})


def _fold(m: DataFrame, names: list[str]) -> DataFrame:
    """Final fold of the per-source rows: one grouped aggregate per scan."""
    return m.groupBy("scan_id").agg(*[
        (F.coalesce(F.sum(n), F.lit(0.0)) if n in m.columns else F.lit(0.0)).alias(n) for n in names])


VULN_POINTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}


def risk_score(findings: DataFrame, compat: DataFrame, missing: DataFrame, suggestions: DataFrame) -> DataFrame:
    """AGG-18: modernization risk 0..100 = sum of vulnerability points
    (critical 20, high 10, medium 5, low 2) + 3 x missing policies + 3 x
    insecure calls + 1 x unsupported feature + 1 x missing config + 5 x high
    'secure' suggestion + 0.5 x min(unsupported, 50); rounded, clamped."""
    s = normalize_severity(F.col("severity"))
    pts = F.lit(0)
    for word, p in VULN_POINTS.items():
        pts = F.when(s == word, F.lit(p)).otherwise(pts)
    k = F.col("kind")
    m = _measures(
        _ms(findings, vuln_points=F.when(k == VULN, pts).otherwise(0), policies=(k == POLICY).cast("int"),
            insecure=(k == INSECURE).cast("int")),
        _m(compat, "unsupported", F.col("unsupported")),
        _m(missing, "missing_configs", F.lit(1)),
        _m(suggestions, "secure_high", ((F.lower(F.coalesce("severity", F.lit(""))) == "high")
                                         & (F.col("category") == "secure")).cast("int")))
    names = ["vuln_points", "policies", "insecure", "unsupported", "missing_configs", "secure_high"]
    f = _fold(m, names)
    raw = (F.col("vuln_points") + 3 * F.col("policies") + 3 * F.col("insecure") + F.col("unsupported")
           + F.col("missing_configs") + 5 * F.col("secure_high") + 0.5 * F.least(F.col("unsupported"), F.lit(50.0)))
    return f.select("scan_id", *[F.col(n).cast("long").alias(n) for n in names],
                    clamp(round_half_up(raw), 0, 100).cast("long").alias("risk"))


def predictive_risk(severity: DataFrame, compat: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-19: risk = clamp(round(5 low + 10 moderate + 20 high + 30 critical),
    0, 100); trend from the high+critical ratio (> 0.25 increasing, < 0.05
    decreasing, else stable); projected debt = round(3 x unsupported + 2 x
    inefficient findings); up to four recommendation lines."""
    m = _measures(
        _ms(severity, low=F.col("low"), moderate=F.col("moderate"), high=F.col("high"), critical=F.col("critical")),
        _m(compat, "unsupported", F.col("unsupported")),
        _m(findings, "inefficient", (F.col("kind") == "inefficient").cast("int")))
    f = _fold(m, ["low", "moderate", "high", "critical", "unsupported", "inefficient"])
    total = F.col("low") + F.col("moderate") + F.col("high") + F.col("critical")
    ratio = F.when(total > 0, (F.col("high") + F.col("critical")) / total).otherwise(F.lit(0.0))
    trend = F.when(ratio > 0.25, "increasing").when(ratio < 0.05, "decreasing").otherwise("stable")
    weighted = 5 * F.col("low") + 10 * F.col("moderate") + 20 * F.col("high") + 30 * F.col("critical")
    recs = F.array_compact(F.array(
        F.when(F.col("critical") > 0, F.lit("Prioritize critical vulnerabilities with immediate patches")),
        F.when(F.col("high") > 5, F.lit("Address high-severity issues within one sprint")),
        F.when(F.col("unsupported") > 0, F.lit("Refactor unsupported code paths and add polyfills where needed")),
        F.when(trend == "increasing", F.lit("Increase test coverage and enable stricter CI checks"))))
    return f.select("scan_id", clamp(round_half_up(weighted), 0, 100).cast("long").alias("risk"),
                    trend.alias("trend"),
                    round_half_up(3 * F.col("unsupported") + 2 * F.col("inefficient")).cast("long").alias("projected_debt"),
                    F.array_join(recs, "\n").alias("recommendations"))


def compliance_report(findings: DataFrame, compat: DataFrame, recommendations_df: DataFrame,
                      large: DataFrame, standards) -> DataFrame:
    """AGG-20 (+JOIN-20): one row per scan x standard: status attention/pass,
    base findings (vulnerabilities + missing policies), unsupported, missing
    policies, large assets and the first 20 recommendations."""
    from codelens.operators.joins import scan_standards
    k = F.col("kind")
    m = _measures(_ms(findings, vulns=(k == VULN).cast("int"), policies=(k == POLICY).cast("int")),
                  _m(compat, "unsupported", F.col("unsupported")), _m(large, "large_assets", F.lit(1)))
    f = _fold(m, ["vulns", "policies", "unsupported", "large_assets"])
    recs = recommendations_df.groupBy("scan_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("ord", "recommendation"))), 1, 20).alias("_r"))
    base = f.join(recs, "scan_id", "left")
    base_findings = (F.col("vulns") + F.col("policies")).cast("long")
    out = base.select("scan_id", base_findings.alias("base_findings"), F.col("unsupported").cast("long").alias("unsupported"),
                      F.col("policies").cast("long").alias("missing_policies"),
                      F.col("large_assets").cast("long").alias("large_assets"),
                      F.array_join(F.transform(F.coalesce("_r", F.array()), lambda x: x["recommendation"]), "\n").alias("recommendations"))
    out = out.withColumn("status", F.when(F.col("base_findings") + F.col("unsupported") > 0, "attention").otherwise("pass"))
    return scan_standards(out, standards)


#: Report column -> name under which a tool's run is stored.
TOOLS_SAST = {"semgrep": "semgrep", "npm": "npm-audit", "owasp_dependency_check": "owasp-dependency-check", "safety": "safety"}


def _top_lines(findings: DataFrame, name: str, k: int = 50) -> DataFrame:
    """(scan_id, name): the k most severe findings of each scan as lines ``[severity] title``."""
    line = F.concat(F.lit("["), F.coalesce("severity", F.lit("unknown")), F.lit("] "), F.coalesce("title", F.lit("")))
    top = top_findings(findings, k).select("scan_id", F.struct("rank", line.alias("line")).alias("e"))
    return top.groupBy("scan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]), "\n").alias(name))


def sast_report(findings: DataFrame, compat: DataFrame, tool_runs: DataFrame, frameworks: DataFrame) -> DataFrame:
    """AGG-21: per scan vulnerability counts (AGG-05), hygiene counts
    (AGG-06), unsupported count, frameworks, CI summary (AGG-23), the 50 top findings of
    both groups, tool statuses (``not_executed`` when a tool has no run) and the
    number of semgrep findings."""
    k = F.col("kind")
    b = severity_bucket(F.col("severity"), "low")
    s = normalize_severity(F.col("severity"))
    hyg = k.isin(POLICY, INSECURE)
    fm = {f"v_{x}": ((k == VULN) & (b == x)).cast("int") for x in ["critical", "high", "medium", "low"]}
    fm.update({f"h_{x}": (hyg & (b == x)).cast("int") for x in ["critical", "high", "medium", "low"]})
    fm.update({"ci_workflows": (k == CI).cast("int"), "ci_high": ((k == CI) & s.isin("critical", "high")).cast("int"),
               "ci_medium": ((k == CI) & (s == "medium")).cast("int"), "ci_low": ((k == CI) & (s == "low")).cast("int")})
    parts = [_ms(findings, **fm), _m(compat, "unsupported", F.col("unsupported"))]
    names = [f"{p}_{x}" for p in ("v", "h") for x in ("critical", "high", "medium", "low")] + \
            ["ci_workflows", "ci_high", "ci_medium", "ci_low", "unsupported"]
    f = _fold(_measures(*parts), names)
    semgrep = F.max(F.when(F.col("tool") == TOOLS_SAST["semgrep"], F.col("findings")))
    st = tool_runs.groupBy("scan_id").agg(support_map("tool", F.col("status")).alias("_t"), semgrep.alias("_semgrep"))
    fw = frameworks.groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("frameworks"))
    j = (f.join(st, "scan_id", "left").join(fw, "scan_id", "left")
         .join(_top_lines(findings.filter(k == VULN), "top_vulnerabilities"), "scan_id", "left")
         .join(_top_lines(findings.filter(hyg), "top_hygiene"), "scan_id", "left"))
    tools = [F.coalesce(F.try_element_at("_t", F.lit(t)), F.lit("not_executed")).alias("tool_" + c) for c, t in TOOLS_SAST.items()]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("frameworks", "top_vulnerabilities", "top_hygiene")]
    return j.select("scan_id", *[F.col(n).cast("long").alias(n) for n in names], *tools,
                    F.coalesce("_semgrep", F.lit(0)).cast("long").alias("semgrep_findings"), *texts)


def secrets_report(findings: DataFrame, tool_runs: DataFrame) -> DataFrame:
    """AGG-22: secret counts (AGG-07), the 50 top secrets, the status of the three
    secret scanners (``not_executed`` if one did not run) and trufflehog's
    findings count."""
    c = secret_counts(findings)
    runs = tool_runs.groupBy("scan_id").agg(support_map("tool", F.col("status")).alias("_t"),
                                            F.max(F.when(F.col("tool") == "trufflehog", F.col("findings"))).alias("_n"))
    j = c.join(runs, "scan_id", "left").join(_top_lines(secret_items(findings), "top_secrets"), "scan_id", "left")
    tools = [F.coalesce(F.try_element_at("_t", F.lit(t)), F.lit("not_executed")).alias(t.replace("-", "_") + "_status")
             for t in ("trufflehog", "gitleaks", "detect-secrets")]
    return j.select(*c.columns, *tools, F.coalesce("_n", F.lit(0)).cast("long").alias("trufflehog_findings"),
                    F.coalesce("top_secrets", F.lit("")).alias("top_secrets"))


def scan_impact(files: DataFrame, changed: DataFrame, polyfills_removed: DataFrame | None = None) -> DataFrame:
    """AGG-26: round((changed files + polyfills removed) / scanned x 100), 0
    when nothing was scanned (Q7: only files actually in the changed list count)."""
    ch = files.join(changed.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi")
    parts = [_m(files, "scanned", F.lit(1)), _m(ch, "changed", F.lit(1))]
    if polyfills_removed is not None:
        parts.append(_m(polyfills_removed, "polyfills", F.lit(1)))
    f = _fold(_measures(*parts), ["scanned", "changed", "polyfills"])
    return f.select("scan_id", F.col("scanned").cast("long").alias("scanned"), F.col("changed").cast("long").alias("changed"),
                    F.when(F.col("scanned") == 0, F.lit(0)).otherwise(
                        round_half_up((F.col("changed") + F.col("polyfills")) / F.col("scanned") * 100)).cast("long").alias("impact"))


def scan_statistics(scanned: DataFrame, analyzed: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-27: files scanned / ignored (scanned - analyzed, >= 0), issues =
    vulnerabilities + insecure calls + missing policies + secrets, hygiene
    issues, secrets and the warning list — for every scan (Q10)."""
    k = F.col("kind")
    s = normalize_severity(F.col("severity"))
    m = _measures(_m(scanned, "scanned", F.lit(1)), _m(analyzed, "analyzed", F.lit(1)),
                  _ms(findings, vulns=(k == VULN).cast("int"), insecure=(k == INSECURE).cast("int"),
                      policies=(k == POLICY).cast("int"), secrets=(k == SECRET).cast("int"),
                      critical=((k == VULN) & (s == "critical")).cast("int")))
    f = _fold(m, ["scanned", "analyzed", "vulns", "insecure", "policies", "secrets", "critical"])
    L = {n: F.col(n).cast("long") for n in ["scanned", "analyzed", "vulns", "insecure", "policies", "secrets", "critical"]}
    warnings = F.array_compact(F.array(
        F.when(L["critical"] > 0, F.concat(L["critical"].cast("string"), F.lit(" critical vulnerabilities detected"))),
        F.when(L["policies"] > 0, F.lit("Missing security policies")),
        F.when(L["insecure"] > 0, F.lit("Insecure API calls detected"))))
    return f.select("scan_id", L["scanned"].alias("files_scanned"),
                    F.greatest(F.lit(0), L["scanned"] - L["analyzed"]).alias("files_ignored"),
                    (L["vulns"] + L["insecure"] + L["policies"] + L["secrets"]).alias("issues_found"),
                    L["vulns"].alias("vulnerabilities"), (L["policies"] + L["insecure"]).alias("hygiene_issues"),
                    L["secrets"].alias("secrets_found"), F.array_join(warnings, "\n").alias("warnings"))


def log_level(msg: Column) -> Column:
    """AGG-32: error/fail -> error; warn -> warn; done/complete/success -> success; else info."""
    t = F.lower(F.coalesce(msg, F.lit("")))
    return (F.when(t.contains("error") | t.contains("fail"), "error").when(t.contains("warn"), "warn")
            .when(t.contains("done") | t.contains("complete") | t.contains("success"), "success").otherwise("info"))


def log_levels(logs: DataFrame) -> DataFrame:
    """AGG-32: count of log lines per level per scan."""
    return logs.groupBy("scan_id", log_level(F.col("msg")).alias("level")).agg(F.count(F.lit(1)).alias("lines"))


def change_narrative(risk: DataFrame, suggestions: DataFrame, vulns: DataFrame,
                     rationale_df: DataFrame | None = None) -> DataFrame:
    """AGG-34: the change narrative text per scan: risk line, suggestion
    category counts, vulnerability severity counts (when any) and up to three
    rationale lines."""
    cat = F.when(F.col("category").isin(*KNOWN_CATEGORIES), F.col("category")).otherwise("modernize")
    sev = F.lower(F.coalesce("severity", F.lit("")))
    parts = [_m(risk, "risk", F.col("risk")),
             _ms(suggestions, items=F.lit(1), **{"c_" + c: (cat == c).cast("int") for c in KNOWN_CATEGORIES}),
             _ms(vulns, vulns=F.lit(1), **{"s_" + x: (sev == x).cast("int") for x in ["critical", "high", "medium", "low"]})]
    names = ["risk", "items"] + ["c_" + c for c in KNOWN_CATEGORIES] + ["vulns"] + \
            ["s_" + s for s in ["critical", "high", "medium", "low"]]
    f = _fold(_measures(*parts), names)
    L = {n: F.col(n).cast("long").cast("string") for n in names}
    lines = F.array(
        F.concat(F.lit("Modernization Risk Score: "), L["risk"], F.lit("/100")),
        F.concat(F.lit("Changes planned: "), L["items"], F.lit(" suggestions — security="), L["c_secure"],
                 F.lit(", modernization="), L["c_modernize"], F.lit(", performance="), L["c_performance"],
                 F.lit(", maintenance="), L["c_cleanup"], F.lit(".")),
        F.when(F.col("vulns") > 0, F.concat(F.lit("Detected vulnerabilities — critical="), L["s_critical"],
                                            F.lit(", high="), L["s_high"], F.lit(", medium="), L["s_medium"],
                                            F.lit(", low="), L["s_low"], F.lit("."))))
    out = f.select("scan_id", F.array_compact(lines).alias("_l"))
    if rationale_df is not None:
        r = rationale_df.select("scan_id", F.slice("rationale", 1, 3).alias("_r"))
        out = out.join(r, "scan_id", "left").select("scan_id", F.when(F.size(F.coalesce("_r", F.array())) > 0, F.concat(
            "_l", F.array(F.lit("Rationale:")),
            F.transform("_r", lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["detail"])))).otherwise(F.col("_l")).alias("_l"))
    return out.select("scan_id", F.array_join("_l", "\n").alias("narrative"))
