"""Joins with dimensions and between scan sections (JOIN-05, 06, 12..18, 20, 21).

Small dimensions are broadcast only when their size is bounded (literal rule
lists, or a plan size estimate under the threshold); everything else is left
to Catalyst / AQE.  First-match semantics use ``min_by`` over an ordinal, a
grouped aggregate rather than a window over a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.dims import bounded_broadcast


def dependency_status(deps: DataFrame, outdated: DataFrame) -> DataFrame:
    """JOIN-05: each inventory row with ``latest`` and status ``Outdated``
    (current differs from latest) or ``OK``."""
    o = outdated.select("scan_id", "name", "current", "latest")
    j = deps.join(o, ["scan_id", "name"], "left")
    return j.withColumn("status", F.when(F.col("latest").isNotNull() & (F.col("current") != F.col("latest")),
                                         "Outdated").otherwise("OK"))


# FIXED VALUES: framework -> package name (JOIN-06); other frameworks use
# their lower-cased name
FRAMEWORK_PACKAGES = [("React", "react"), ("Angular", "angular"), ("Vue", "vue"), ("Next.js", "next"),
                      ("Express", "express")]


def framework_versions(frameworks: DataFrame, deps: DataFrame, packages: DataFrame) -> DataFrame:
    """JOIN-06: framework -> package name (dim, else the lower-cased framework
    name) -> version of the first inventory row (by ``ord``) whose lower-cased
    name is that package; ``''`` when none."""
    f = frameworks.join(bounded_broadcast(packages), frameworks["name"] == packages["framework"], "left").select(
        "scan_id", frameworks["name"].alias("framework"),
        F.coalesce(F.col("package"), F.lower(frameworks["name"])).alias("package"))
    first = deps.groupBy("scan_id", F.lower(F.col("name")).alias("package")).agg(
        F.min_by("version", "ord").alias("version"))
    return f.join(first, ["scan_id", "package"], "left").select(
        "scan_id", "framework", "package", F.coalesce(F.col("version"), F.lit("")).alias("version"))


def apply_allow_list(frameworks: DataFrame, allow: DataFrame, enforce: bool = True) -> DataFrame:
    """JOIN-12: keep frameworks on the scan's allow list; pass everything when
    enforcement is off or the scan's allow list is empty."""
    if not enforce:
        return frameworks
    a = allow.select("scan_id", "name").distinct()
    has_list = a.select("scan_id").distinct().withColumn("_has", F.lit(True))
    kept = frameworks.join(a, ["scan_id", "name"], "left_semi")
    no_list = frameworks.join(has_list, "scan_id", "left_anti")
    return kept.unionByName(no_list)


def apply_tech_gate(frameworks: DataFrame, tech_dim: DataFrame, enforce: bool = False) -> DataFrame:
    """JOIN-13: technology evaluation gate — absent from the dim: allowed;
    status inactive: dropped; when enforcing, approval is required.  Adds
    ``testing_level`` (default ``smoke``)."""
    t = bounded_broadcast(tech_dim.select("name", "approved", "status", "testing_level"))
    j = frameworks.join(t, "name", "left")
    absent = F.col("status").isNull() & F.col("approved").isNull()
    inactive = F.lower(F.coalesce("status", F.lit(""))) == "inactive"
    ok = absent | (~inactive & (F.lit(not enforce) | F.coalesce("approved", F.lit(False))))
    return j.filter(ok).select(*frameworks.columns, F.coalesce("testing_level", F.lit("smoke")).alias("testing_level"))


# FIXED VALUES: expected configs (JOIN-14)
BASE_EXPECTED_CONFIGS = [".browserslistrc", "postcss.config.js", "babel.config.js"]
CONDITIONAL_CONFIGS = [("TypeScript", "tsconfig.json"), ("eslint", "eslint.config.js"), ("webpack", "webpack.config.js")]


def missing_configs(configs: DataFrame, features: DataFrame, scans: DataFrame) -> DataFrame:
    """JOIN-14: expected config names (3 always, 3 conditional on a feature)
    not present in the scan's configs: expected rows left-anti configs."""
    base = scans.select("scan_id").distinct().select("scan_id", F.explode(
        F.array(*[F.lit(c) for c in BASE_EXPECTED_CONFIGS])).alias("name"))
    cond_dim = F.broadcast(features.sparkSession.createDataFrame(CONDITIONAL_CONFIGS, "feature string, name string"))
    cond = features.select("scan_id", "feature").distinct().join(cond_dim, "feature").select("scan_id", "name")
    expected = base.unionByName(cond).distinct()
    return expected.join(configs.select("scan_id", "name"), ["scan_id", "name"], "left_anti")


def changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """JOIN-15: files of each scan whose path is in its changed-path list."""
    return files.join(changed.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi")


# FIXED VALUES: remediation snippets by title fragment, first rule wins (JOIN-16)
REMEDIATION_RULES = [
    (["Rate limiting"], "Add express-rate-limit", "rateLimit"),
    (["CSRF"], "Enable csurf middleware", "csrf"),
    (["CSP"], "Configure Helmet Content Security Policy", "helmetCsp"),
    (["X-Powered-By"], "Disable X-Powered-By header", "xPoweredBy"),
    (["Permissive CORS", "Wildcard CORS"], "Restrict CORS configuration", "corsRestrict"),
    (["Cookie without httpOnly", "Cookie without secure", "Session cookie flags"],
     "Set secure and httpOnly cookie flags", "secureCookie"),
]


def remediation(findings: DataFrame) -> DataFrame:
    """JOIN-16: finding title -> (label, snippet key) of the first rule whose
    fragment the title contains; chained ``when`` (no join needed)."""
    t = F.coalesce(F.col("title"), F.lit(""))
    label = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    for parts, lab, k in reversed(REMEDIATION_RULES):
        cond = F.lit(False)
        for p in parts:
            cond = cond | t.contains(p)
        label = F.when(cond, F.lit(lab)).otherwise(label)
        key = F.when(cond, F.lit(k)).otherwise(key)
    return findings.withColumn("remedy", label).withColumn("snippet", key)


def latest_snapshot(stored: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """JOIN-17: per key the stored row if there is one, else the live row."""
    s = stored.withColumn("_prio", F.lit(0))
    lv = live.withColumn("_prio", F.lit(1))
    u = s.unionByName(lv, allowMissingColumns=True)
    cols = [c for c in u.columns if c not in (key, "_prio")]
    g = u.groupBy(key).agg(F.min_by(F.struct(*cols, "_prio"), "_prio").alias("_r"))
    return g.select(key, *[F.col("_r." + c).alias(c) for c in cols], F.col("_r._prio").alias("source_prio"))


def merge_section(base: DataFrame, derived: DataFrame, override: DataFrame | None, key: str, field: str) -> DataFrame:
    """JOIN-18: field value = override, else the base list when non-empty,
    else the derived fallback."""
    b = base.select(key, F.col(field).alias("_b"))
    d = derived.select(key, F.col(field).alias("_d"))
    j = b.join(d, key, "full")
    if override is not None:
        j = j.join(override.select(key, F.col(field).alias("_o")), key, "left")
    else:
        j = j.withColumn("_o", F.lit(None).cast(b.schema["_b"].dataType))
    return j.select(key, F.coalesce(F.col("_o"), F.when(F.size("_b") > 0, F.col("_b")), F.col("_d")).alias(field))


def scan_standards(scans: DataFrame, standards: str | list[str]) -> DataFrame:
    """JOIN-20: every scan x every requested standard.  The list is a small
    literal, so this is an ``explode`` of a literal array per scan row, not a
    join."""
    if isinstance(standards, str):
        items = [s.strip().upper() for s in standards.split(",")]
    else:
        items = [s.strip().upper() for s in standards]
    items = [s for s in items if s]
    return scans.select("*", F.explode(F.array(*[F.lit(s) for s in items])).alias("standard"))


def repo_details(scans: DataFrame, manifests: DataFrame, external: DataFrame, key: str = "id",
                 fields: list[str] | None = None) -> DataFrame:
    """JOIN-21: manifest values overridden by non-empty external values."""
    fields = fields or [c for c in external.columns if c != key]
    m = manifests.select(key, *[F.col(c).alias("_m_" + c) for c in fields if c in manifests.columns])
    e = external.select(key, *[F.col(c).alias("_e_" + c) for c in fields])
    j = scans.select(key).join(m, key, "left").join(e, key, "left")
    out = [F.coalesce(F.nullif(F.col("_e_" + c).cast("string"), F.lit("")),
                      F.col("_m_" + c).cast("string") if c in manifests.columns else F.lit(None).cast("string")).alias(c)
           for c in fields]
    return j.select(key, *out)
