"""Window operators (WIN-01..03, 05, 06) and detector routing scores (AGG-31).

Windows are always partitioned by the scan (plus the operator's own group),
and when only the top or first row is needed the filter is a rank filter that
Spark turns into a ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: routing rules.  (group, name, weight) per dependency name or
# prefix, and per file extension / path pattern.
ROUTER_DEP_RULES = [
    # (dependency name, prefix match?, group, name, weight)
    ("next", False, "frameworks", "Next.js", 3),
    ("@sveltejs/kit", False, "frameworks", "SvelteKit", 3),
    ("nuxt", False, "frameworks", "Nuxt", 3),
    ("vue", False, "frameworks", "Vue", 2),
    ("@vue/", True, "frameworks", "Vue", 2),
    ("@angular/core", False, "frameworks", "Angular", 3),
    ("express", False, "frameworks", "Express", 2),
    ("nx", False, "frameworks", "Nx", 2),
    ("@nrwl/", True, "frameworks", "Nx", 2),
    ("typescript", False, "languages", "TypeScript", 2),
]
ROUTER_EXT_RULES = [
    # (extensions, group, name, weight)
    ([".ts", ".tsx"], "languages", "TypeScript", 1),
    ([".js", ".jsx", ".ts", ".tsx"], "languages", "JavaScript", 1),
    ([".py", ".ipynb"], "languages", "Python", 2),
    ([".java"], "languages", "Java", 2),
    ([".go"], "languages", "Go", 2),
]
ROUTER_FILE_EXTS = [".js", ".jsx", ".ts", ".tsx", ".md", ".py", ".java", ".go", ".ipynb"]
# (group, name, order) of the score table; ties rank in this order.
ROUTER_NAMES = [
    ("frameworks", ["Next.js", "SvelteKit", "Nuxt", "Vue", "Angular", "Nx", "Express"]),
    ("languages", ["JavaScript", "TypeScript", "Python", "Java", "Go"]),
    ("ml", ["TensorFlow", "PyTorch", "Keras", "Scikit-learn"]),
]
ML_IMPORT_RULES = [("tensorflow", "TensorFlow", 3), ("torch", "PyTorch", 3), ("keras", "Keras", 2),
                   ("sklearn", "Scikit-learn", 2)]


def _rule_struct(group, name, w):
    return F.struct(F.lit(group).alias("grp"), F.lit(name).alias("name"), F.lit(w).alias("w"))


def router_scores(files: DataFrame, deps: DataFrame) -> DataFrame:
    """AGG-31: ``(scan_id, group, name, score)`` — dependency rules (on the
    distinct dep names of each scan) and file rules add weights; one rule
    array per row, exploded, then a grouped sum (partial aggregation)."""
    dn = deps.select("scan_id", "name").distinct()
    n = F.col("name")
    dep_hits = F.array_compact(F.array(*[
        F.when(n.startswith(d) if pref else (n == d), _rule_struct(g, nm, w))
        for d, pref, g, nm, w in ROUTER_DEP_RULES]))
    # '@vue/' and 'vue' both map to Vue once per scan: dedupe by (scan, group, name, dep-rule).
    d_rows = (dn.select("scan_id", F.explode(dep_hits).alias("h"))
              .select("scan_id", "h.grp", "h.name", "h.w").distinct())
    f = files.filter(F.col("ext").isin(*ROUTER_FILE_EXTS))
    p = F.regexp_replace(F.col("path"), r"\\", "/")
    e = F.col("ext")
    low = F.lower(F.coalesce(F.col("content"), F.lit("")))
    file_rules = [F.when(e.isin(*exts), _rule_struct(g, nm, w)) for exts, g, nm, w in ROUTER_EXT_RULES]
    file_rules += [
        F.when(p.contains("pages/") & (p.endswith(".tsx") | p.endswith(".jsx")), _rule_struct("frameworks", "Next.js", 1)),
        F.when(p.endswith("nuxt.config.ts") | p.endswith("nuxt.config.js"), _rule_struct("frameworks", "Nuxt", 2)),
        F.when(p.endswith("svelte.config.js") | p.contains("src/routes/"), _rule_struct("frameworks", "SvelteKit", 1)),
        F.when(p.endswith("angular.json"), _rule_struct("frameworks", "Angular", 2)),
    ]
    file_rules += [F.when((e == ".py") & low.rlike(rf"(^|[^a-z0-9_])(import|from)\s+{mod}([^a-z0-9_]|$)"),
                          _rule_struct("ml", nm, w)) for mod, nm, w in ML_IMPORT_RULES]
    f_rows = f.select("scan_id", F.explode(F.array_compact(F.array(*file_rules))).alias("h")).select(
        "scan_id", "h.grp", "h.name", "h.w")
    return d_rows.unionByName(f_rows).groupBy("scan_id", "grp", "name").agg(
        F.sum("w").cast("long").alias("score"))


def _name_order() -> Column:
    out = F.lit(99)
    i = 0
    for _, names in ROUTER_NAMES:
        for nm in names:
            out = F.when(F.col("name") == nm, F.lit(i)).otherwise(out)
            i += 1
    return out


def rank_router(scores: DataFrame) -> DataFrame:
    """WIN-01: rank names by score desc within (scan, group), ties in the
    fixed name order; zero scores dropped."""
    w = Window.partitionBy("scan_id", "grp").orderBy(F.col("score").desc(), _name_order(), F.col("name"))
    return scores.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(w).cast("long"))


def allow_threshold(scores: DataFrame, pct: float = 0.5) -> DataFrame:
    """WIN-02: allowed iff score >= max(1, floor(max_score x pct)) within the
    (scan, group); pct clamped to [0, 1].  The group max is an aggregate
    joined back (one row per group)."""
    p = min(1.0, max(0.0, float(pct)))
    s = scores.filter(F.col("score") > 0)
    mx = s.groupBy("scan_id", "grp").agg(F.max("score").alias("max_score"))
    thr = F.greatest(F.lit(1), F.floor(F.col("max_score") * F.lit(p))).cast("long")
    return s.join(mx, ["scan_id", "grp"]).withColumn("threshold", thr).withColumn(
        "allowed", F.col("score") >= F.col("threshold")).drop("max_score")


def order_frameworks(frameworks: DataFrame, ranks: DataFrame) -> DataFrame:
    """WIN-03: position of each framework: router rank first (unknown last),
    ties by name."""
    r = ranks.filter(F.col("grp") == "frameworks").select("scan_id", "name", F.col("rank").alias("_r"))
    j = frameworks.join(r, ["scan_id", "name"], "left")
    w = Window.partitionBy("scan_id").orderBy(F.coalesce("_r", F.lit(1 << 30)), F.col("name"))
    return j.withColumn("position", F.row_number().over(w).cast("long")).drop("_r")


def first_match(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """WIN-05: first row per group in the given order (``find``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def retention(entries: DataFrame, now, ttl_seconds: int, budget_bytes: int,
              by: list[str] | None = None) -> DataFrame:
    """WIN-06: cache retention.  Entries older than the TTL expire; of the
    rest, walking newest first, an entry is kept while the running total of
    sizes (including it) stays within the budget, i.e. the oldest are evicted
    until the total fits.  Ties on mtime are broken by path.

    The newest-first running total is a distributed running sum (range
    partitioned by root and time), so one large cache root is not one task.
    Returns every entry with ``action`` in keep / expire / evict."""
    from codelens.operators.ordered import running_sum
    by = by or ["root"]
    now_c = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    age = F.unix_timestamp(now_c) - F.unix_timestamp(F.col("mtime"))
    # a TTL or budget of 0 (or less) switches that rule off
    e = entries.withColumn("_expired", (age > F.lit(ttl_seconds)) & F.lit(ttl_seconds > 0))
    live = running_sum(e.filter(~F.col("_expired")), by, ["-mtime", "path"], F.col("size"), "running_bytes")
    live = live.withColumn("running_bytes", F.col("running_bytes").cast("long"))
    dead = e.filter(F.col("_expired")).withColumn("running_bytes", F.lit(None).cast("long"))
    return live.unionByName(dead).withColumn(
        "action", F.when(F.col("_expired"), "expire")
        .when(F.lit(budget_bytes > 0) & (F.col("running_bytes") > budget_bytes), "evict")
        .otherwise("keep")).drop("_expired")
