"""Queries: validation / normalisation (DET-32..35), remediation suggestions
(TXT-08), rationale (TXT-11), share of max (WIN-04), section joins (JOIN-18,
JOIN-21) and the detector registry (UDF-01..03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import joins as J
from codelens.operators import registry as R
from codelens.operators import score as S
from codelens.operators import text as X
from codelens.operators import validate as VA
from codelens.operators import window as W
from codelens.operators.detect import detect_configs, tech_classes
from codelens.plans import bindings as V
from codelens.plans.catalog import ORACLE, register
from codelens.plans.q_scores import COMPAT_SQL
from codelens.sources import tools as TL

SCANS = f"({V.V_SCANS_SQL})"
FIND = f"({V.V_FINDINGS_SQL})"


def requests_df(spark, sf_dir):
    """Scan requests: done scans by URL with their priority as branch, open
    ones by GitHub URL with the customer name as branch (has '#'), pending
    ones as zip uploads of the base64 of the URL."""
    s = V.v_scans(spark, sf_dir)
    st = F.col("status")
    return s.select(
        "id",
        F.when(st == "done", "url").when(st == "queued", "github").otherwise("zip").alias("inputType"),
        F.when(st != "processing", F.col("repo_url")).alias("repoUrl"),
        F.when(st == "processing", F.base64(F.encode("repo_url", "UTF-8"))).alias("zipBuffer"),
        F.when(st == "done", F.col("branch")).otherwise(F.regexp_extract("repo_url", r"github\.com/([^/]+)/", 1)).alias("branch"))


DET32_SQL = f"""
WITH r AS (SELECT id,
  CASE status WHEN 'done' THEN 'url' WHEN 'queued' THEN 'github' ELSE 'zip' END AS inputType,
  CASE WHEN status <> 'processing' THEN repo_url END AS repoUrl,
  CASE WHEN status = 'processing' THEN to_base64(encode(repo_url)) END AS zipBuffer,
  CASE WHEN status = 'done' THEN branch ELSE regexp_extract(repo_url, 'github\\.com/([^/]+)/', 1) END AS branch
  FROM {SCANS})
SELECT id, CAST(
  (CASE WHEN inputType IN ('github', 'url') AND NOT regexp_matches(trim(repoUrl), '^(?i)(https?|ftp)://([A-Za-z0-9-]+\\.)+[A-Za-z0-9-]+(:[0-9]+)?([/?#][^\\s]*)?$') THEN 1 ELSE 0 END) +
  (CASE WHEN inputType = 'zip' AND NOT regexp_matches(coalesce(zipBuffer, ''), '^[A-Za-z0-9+/=]+$') THEN 1 ELSE 0 END) +
  (CASE WHEN branch IS NOT NULL AND NOT (length(trim(branch)) BETWEEN 1 AND 256) THEN 1 ELSE 0 END) +
  (CASE WHEN branch IS NOT NULL AND NOT regexp_matches(trim(branch), '^[A-Za-z0-9_\\-./]+$') THEN 1 ELSE 0 END)
  AS BIGINT) AS n_errors
FROM r
"""


@register("DET-32", DET32_SQL)
def q_det32(spark, sf_dir):
    v = VA.validate_requests(requests_df(spark, sf_dir))
    return v.select("id", F.size("errors").cast("long").alias("n_errors"))


DET33_SQL = f"""
SELECT scan_id, supported, partial, unsupported,
       (supported + partial + unsupported) > 0 OR length(trim(supported_features)) > 0 AS show_analytics,
       supported_features <> '' AND lower(trim(supported_features)) NOT IN ('unknown', 'n/a', 'na') AS show_supported,
       CAST(((supported + partial + unsupported) > 0 OR length(trim(supported_features)) > 0) = false AS INTEGER)
       + CAST((supported_features <> '' AND lower(trim(supported_features)) NOT IN ('unknown', 'n/a', 'na')) = false AS INTEGER) AS hidden_sections
FROM ({COMPAT_SQL})
"""


@register("DET-33", DET33_SQL)
def q_det33(spark, sf_dir):
    from codelens import dims
    c = S.compatibility(V.v_features(spark, sf_dir), dims.feature_dim(spark)).select(
        "scan_id", "supported", "partial", "unsupported", "supported_features")
    c = c.withColumn("_counts", F.array("supported", "partial", "unsupported"))
    v = VA.section_visibility(c, {"analytics": ["_counts", "supported_features"], "supported": ["supported_features"]})
    return v.select("scan_id", "supported", "partial", "unsupported", "show_analytics", "show_supported",
                    "hidden_sections")


def feature_docs(spark, sf_dir):
    """JSON documents of three shapes from the feature table (per scan-file):
    map file -> [features], array of names, array of {name} objects."""
    f = V.v_features(spark, sf_dir)
    g = f.groupBy("scan_id", "file").agg(F.array_sort(F.collect_set("feature")).alias("fs"))
    shape = F.abs(F.xxhash64("file")) % 3
    doc = (F.when(shape == 0, F.to_json(F.create_map(F.col("file"), F.col("fs"))))
           .when(shape == 1, F.to_json(F.col("fs")))
           .otherwise(F.to_json(F.transform("fs", lambda x: F.struct(x.alias("name"))))))
    return g.select("scan_id", "file", doc.alias("json"))


DET34_SQL = f"""
SELECT scan_id, file, array_to_string(list_sort(list(DISTINCT feature)), ',') AS features
FROM ({V.V_FEATURES_SQL}) GROUP BY scan_id, file
"""


@register("DET-34", DET34_SQL)
def q_det34(spark, sf_dir):
    n = VA.normalize_features(feature_docs(spark, sf_dir), "json")
    return n.select("scan_id", "file", F.array_join("features", ",").alias("features"))


def vuln_docs(spark, sf_dir):
    f = V.v_findings(spark, sf_dir).filter(F.col("kind") == "vulnerability")
    m = F.col("ord") % 4
    obj = F.struct(
        F.when(m == 0, F.col("file")).alias("module_name"), F.when(m == 1, F.col("file")).alias("name"),
        F.when(m == 2, F.col("file")).alias("package"),
        F.when(m != 3, F.col("title")).alias("title"),
        F.when(m == 3, F.array(F.col("title"))).alias("via"),
        F.when(m % 2 == 0, F.col("severity")).alias("severity"), F.when(m % 2 == 1, F.col("severity")).alias("level"),
        F.when(m == 0, F.struct(F.lit("pkg").alias("name"), F.col("ord").cast("string").alias("version")))
        .alias("fixAvailable_obj"))
    js = F.to_json(obj)
    # rename the object form of fixAvailable; odd ords get a boolean flag
    js = F.regexp_replace(js, '"fixAvailable_obj"', '"fixAvailable"')
    js = F.when(m == 1, F.regexp_replace(js, r"\}$", ',"fixAvailable":true}')).otherwise(js)
    return f.select("scan_id", "ord", js.alias("json"))


DET35_SQL = f"""
SELECT scan_id, ord,
  CASE WHEN ord % 4 = 3 OR file IS NULL THEN 'Unknown Package' ELSE file END AS vuln_name,
  title AS vuln_title, coalesce(severity, 'unknown') AS vuln_severity, '' AS vuln_range,
  CASE WHEN ord % 4 = 0 THEN 'pkg@' || CAST(ord AS VARCHAR) WHEN ord % 4 = 1 THEN 'Available' ELSE 'N/A' END AS vuln_fix
FROM {FIND} WHERE kind = 'vulnerability'
"""


@register("DET-35", DET35_SQL)
def q_det35(spark, sf_dir):
    n = VA.normalize_vulns(vuln_docs(spark, sf_dir), "json")
    return n.select("scan_id", "ord", "vuln_name", "vuln_title", "vuln_severity", "vuln_range", "vuln_fix")


TXT08_SQL = f"""
WITH s AS (SELECT DISTINCT scan_id FROM {FIND}),
p AS (SELECT scan_id, max(CASE WHEN contains(lower(title), 'dependabot') THEN 1 ELSE 0 END) AS dep,
             max(CASE WHEN contains(lower(title), 'codeql') THEN 1 ELSE 0 END) AS cq
      FROM {FIND} WHERE kind = 'missing_policy' GROUP BY scan_id)
SELECT s.scan_id, f.file, f.category, f.severity, md5(f.patch) AS patch_md5
FROM s LEFT JOIN p ON s.scan_id = p.scan_id,
     (VALUES ('{VA.DEPENDABOT[0]}', 'secure', 'Medium', '{VA.new_file_patch(VA.DEPENDABOT[0], VA.DEPENDABOT[3]).replace("'", "''")}', 0),
             ('{VA.CODEQL[0]}', 'secure', 'Medium', '{VA.new_file_patch(VA.CODEQL[0], VA.CODEQL[3]).replace("'", "''")}', 1),
             ('{VA.SECURITY_WORKFLOW[0]}', 'secure', 'Low', '{VA.new_file_patch(VA.SECURITY_WORKFLOW[0], VA.SECURITY_WORKFLOW[3]).replace("'", "''")}', 2))
       AS f(file, category, severity, patch, k)
WHERE (f.k = 0 AND coalesce(p.dep, 0) = 0) OR (f.k = 1 AND coalesce(p.cq, 0) = 0) OR f.k = 2
"""


@register("TXT-08", TXT08_SQL)
def q_txt08(spark, sf_dir):
    f = V.v_findings(spark, sf_dir)
    r = VA.remediation_suggestions(f, f.select("scan_id"))
    return r.select("scan_id", "file", "category", "severity", F.md5("patch").alias("patch_md5"))


@register("TXT-11", None)
def q_txt11(spark, sf_dir):
    from codelens.plans.q_diff import router
    allow = W.allow_threshold(router(spark, sf_dir), 0.5)
    reasons = allow.select("scan_id", F.lit("router").alias("label"),
                           F.concat(F.col("grp"), F.lit(" "), F.col("name"), F.lit(" score "), F.col("score").cast("string")).alias("detail"),
                           F.col("score").alias("ord"))
    return X.rationale(allow, reasons).select("scan_id", F.to_json("rationale").alias("rationale"))


WIN04_SQL = """
WITH p AS (SELECT o_orderpriority AS scan_id, o_custkey AS customer, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2)
SELECT scan_id, customer, n,
  CAST(least(100, greatest(1, floor(n * 1.0 / max(n) OVER (PARTITION BY scan_id) * 100 + 0.5))) AS BIGINT) AS pct
FROM p
"""


@register("WIN-04", WIN04_SQL)
def q_win04(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_orderpriority").alias("scan_id"), F.col("o_custkey").alias("customer")).agg(
        F.count(F.lit(1)).alias("n"))
    return S.share_of_max(p, "n", ["scan_id"])


JOIN18_SQL = f"""
WITH b AS (SELECT scan_id, list(name ORDER BY name) FILTER (WHERE kind = 'frameworks') AS fw FROM ({V.V_NAMES_SQL}) GROUP BY scan_id),
d AS (SELECT scan_id, list(name ORDER BY name) FILTER (WHERE kind = 'buildTools') AS fw FROM ({V.V_NAMES_SQL}) GROUP BY scan_id)
SELECT coalesce(b.scan_id, d.scan_id) AS scan_id,
       array_to_string(CASE WHEN len(b.fw) > 0 THEN b.fw ELSE d.fw END, ',') AS ui
FROM b FULL JOIN d ON b.scan_id = d.scan_id
"""


@register("JOIN-18", JOIN18_SQL)
def q_join18(spark, sf_dir):
    n = V.v_names(spark, sf_dir)

    def lists(kind):
        return n.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))).alias("ui"))
    m = J.merge_section(lists("frameworks"), lists("buildTools"), None, "scan_id", "ui")
    return m.select("scan_id", F.array_join("ui", ",").alias("ui"))


JOIN21_SQL = f"""
SELECT s.id, coalesce(nullif(CASE WHEN s.status = 'done' THEN 'ext-' || s.branch END, ''), s.repo_url) AS repo_url,
       coalesce(nullif(CASE WHEN s.status = 'done' THEN '' END, ''), CAST(s.created_at AS VARCHAR)) AS created
FROM {SCANS} s
"""


@register("JOIN-21", JOIN21_SQL)
def q_join21(spark, sf_dir):
    s = V.v_scans(spark, sf_dir)
    manifests = s.select("id", "repo_url", F.col("created_at").cast("string").alias("created"))
    external = s.select("id", F.when(F.col("status") == "done", F.concat(F.lit("ext-"), F.col("branch"))).alias("repo_url"),
                        F.when(F.col("status") == "done", F.lit("")).alias("created"))
    return J.repo_details(s.select("id"), manifests, external, "id", ["repo_url", "created"])


UDF01_SQL = f"""
WITH pf AS (SELECT DISTINCT scan_id, feature FROM ({V.V_FEATURES_SQL})
            UNION SELECT DISTINCT scan_id, 'GitHub Actions' FROM ({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL})
            WHERE regexp_matches(path, '(^|/)\\.github/workflows/'))
SELECT scan_id, count(*) AS features, 2 AS executed, 1 AS skipped FROM pf GROUP BY scan_id
"""


@register("UDF-01", UDF01_SQL)
def q_udf01(spark, sf_dir):
    """Registry run over the corpus tables: the built-in sample detector, a
    detector that adds tech classes and a deliberately broken one (logged and
    skipped).  Reports project features per scan and the run's executed /
    skipped detector counts."""
    files = V.v_files(spark, sf_dir).unionByName(V.v_code(spark, sf_dir))
    tables = {"files": files, "configs": detect_configs(files),
              "project_features": V.v_features(spark, sf_dir).select("scan_id", "feature").distinct()}

    def classes(t):
        return {"tech_classes": tech_classes(V.v_deps(spark, sf_dir), t["configs"], t["configs"])}

    def broken(t):
        return {"bad": t["files"].select("no_such_column")}
    out, log = R.run_detectors(spark, tables, [("sample-detector", R.sample_detector), ("tech-classes", classes),
                                               ("broken", broken)])
    executed = sum(1 for line in log if line.startswith("[plugin] Executed"))
    skipped = sum(1 for line in log if line.startswith("[plugin] Error in"))
    return out["project_features"].groupBy("scan_id").agg(F.count(F.lit(1)).alias("features")).select(
        "scan_id", "features", F.lit(executed).alias("executed"), F.lit(skipped).alias("skipped"))


UDF02_SQL = f"""
SELECT DISTINCT scan_id, 'GitHub Actions' AS feature FROM ({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL})
WHERE regexp_matches(path, '(^|/)\\.github/workflows/')
"""


@register("UDF-02", UDF02_SQL)
def q_udf02(spark, sf_dir):
    files = V.v_files(spark, sf_dir).unionByName(V.v_code(spark, sf_dir))
    out = R.sample_detector({"files": files, "configs": detect_configs(files)})
    return out["project_features"]


UDF02B_SQL = f"""
SELECT DISTINCT scan_id, 'Docker' AS name FROM ({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL})
WHERE basename IN ('docker-compose.yml', 'Dockerfile')
"""


@register("UDF-02-frameworks", UDF02B_SQL)
def q_udf02b(spark, sf_dir):
    files = V.v_files(spark, sf_dir).unionByName(V.v_code(spark, sf_dir))
    return R.sample_detector({"files": files, "configs": detect_configs(files)})["frameworks"]


def _udf03_sql():
    from codelens.plans.q_sources import SRC11_SQL, SRC12_AUDIT_SQL, SRC12_SQL, SRC10_SQL
    return f"""
SELECT scan_id, 'semgrep' AS tool, title AS name, severity FROM ({SRC10_SQL})
UNION ALL SELECT scan_id, 'trufflehog', title, 'High' FROM ({SRC11_SQL})
UNION ALL SELECT scan_id, 'npm-audit', name, severity FROM ({SRC12_AUDIT_SQL})
UNION ALL SELECT scan_id, 'npm-outdated', name, NULL FROM ({SRC12_SQL})
"""


@register("UDF-03", _udf03_sql())
def q_udf03(spark, sf_dir):
    """Every tool's raw output through the one ingest entry."""
    from codelens.plans.q_sources import audit_docs, outdated_docs, semgrep_docs, trufflehog_lines
    raw = {"semgrep": semgrep_docs, "trufflehog": trufflehog_lines, "npm-audit": audit_docs, "npm-outdated": outdated_docs}
    out = None
    for tool, docs in raw.items():
        r = TL.ingest_tool(tool, docs(spark, sf_dir))
        name = "title" if "title" in r.columns else "name"
        severity = F.col("severity") if "severity" in r.columns else F.lit(None).cast("string")
        r = r.select("scan_id", F.lit(tool).alias("tool"), F.col(name).alias("name"), severity.alias("severity"))
        out = r if out is None else out.unionByName(r)
    return out


def _txt11_sql():
    from codelens.plans.q_diff import WIN02_SQL
    return f"""
WITH a AS ({WIN02_SQL}),
l AS (SELECT scan_id, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE grp = 'frameworks')), ', ') AS fw,
             array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE grp = 'languages')), ', ') AS lang
      FROM a WHERE allowed GROUP BY scan_id),
r AS (SELECT scan_id, label, detail, row_number() OVER (PARTITION BY scan_id ORDER BY ord, label, detail) AS rn
      FROM (SELECT scan_id, 'router' AS label, grp || ' ' || name || ' score ' || CAST(score AS VARCHAR) AS detail,
                   score AS ord FROM a)),
rr AS (SELECT scan_id, list({{'label': label, 'detail': detail}} ORDER BY rn) AS x FROM r WHERE rn <= 4 GROUP BY scan_id)
SELECT l.scan_id, to_json(list_concat([
         {{'label': 'features', 'detail': 'Suggestions derived from detected features and configs'}},
         {{'label': 'guardrails', 'detail': 'Secrets redacted; unsafe actions filtered; rate limited'}},
         {{'label': 'router-hints', 'detail': 'Allowed frameworks: ' || coalesce(nullif(fw, ''), 'none')
                                           || '; allowed languages: ' || coalesce(nullif(lang, ''), 'none')}}],
         coalesce(rr.x, []))) AS rationale
FROM l LEFT JOIN rr ON l.scan_id = rr.scan_id
"""


ORACLE["TXT-11"] = _txt11_sql()
