"""Queries: findings aggregates, suggestion scores, top-k (AGG-*, TOP-*, WIN-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import dims
from codelens.operators import score as S
from codelens.operators import topk as T
from codelens.plans import bindings as V
from codelens.plans.catalog import register

FD = V.feature_dim_sql()
FIND = f"({V.V_FINDINGS_SQL})"
SUGG = f"({V.V_SUGGESTIONS_SQL})"

# normalised severity in SQL (critical / high / medium(=moderate) / low / unknown)
NSEV = ("CASE WHEN lower(trim(severity)) LIKE '%critical%' THEN 'critical' "
        "WHEN lower(trim(severity)) LIKE 'high%' THEN 'high' "
        "WHEN lower(trim(severity)) LIKE 'medium%' OR lower(trim(severity)) LIKE 'moderate%' THEN 'medium' "
        "WHEN lower(trim(severity)) LIKE 'low%' THEN 'low' ELSE 'unknown' END")
BUCKET = f"CASE WHEN ({NSEV}) = 'unknown' THEN 'low' ELSE ({NSEV}) END"


def cnt(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def bucket_sql(src: str, by: str = "scan_id") -> str:
    return (f"SELECT {by}, {cnt(f'({BUCKET}) = ' + chr(39) + 'critical' + chr(39))} AS critical, "
            f"{cnt(f'({BUCKET}) = ' + chr(39) + 'high' + chr(39))} AS high, "
            f"{cnt(f'({BUCKET}) = ' + chr(39) + 'medium' + chr(39))} AS medium, "
            f"{cnt(f'({BUCKET}) = ' + chr(39) + 'low' + chr(39))} AS low FROM {src} GROUP BY {by}")


def findings(spark, sf_dir):
    return V.v_findings(spark, sf_dir)


def vulns(spark, sf_dir):
    return findings(spark, sf_dir).filter(F.col("kind") == S.VULN)


SEV_SUMMARY_SQL = f"""
SELECT scan_id, {cnt(f"({NSEV}) = 'low'")} AS low, {cnt(f"({NSEV}) = 'medium'")} AS moderate,
       {cnt(f"({NSEV}) = 'high'")} AS high, {cnt(f"({NSEV}) = 'critical'")} AS critical,
       {cnt(f"({NSEV}) = 'unknown'")} AS unknown
FROM {FIND} WHERE kind = 'vulnerability' GROUP BY scan_id
"""


@register("AGG-04", SEV_SUMMARY_SQL)
def q_agg04(spark, sf_dir):
    return S.severity_summary(vulns(spark, sf_dir))


@register("AGG-05", bucket_sql(f"(SELECT * FROM {FIND} WHERE kind = 'vulnerability')"))
def q_agg05(spark, sf_dir):
    return S.vuln_counts(vulns(spark, sf_dir))


@register("AGG-06", bucket_sql(f"(SELECT * FROM {FIND} WHERE kind IN ('insecure_api', 'missing_policy'))"))
def q_agg06(spark, sf_dir):
    return S.hygiene_counts(findings(spark, sf_dir))


SECRET_SRC = (f"(SELECT * FROM {FIND} WHERE kind = 'secret' OR (kind = 'vulnerability' AND "
              f"regexp_matches(coalesce(nullif(title, ''), description, ''), '(?i)(secret|credential|token|key)')))")


@register("AGG-07", f"SELECT *, critical + high + medium + low AS total FROM ({bucket_sql(SECRET_SRC)})")
def q_agg07(spark, sf_dir):
    return S.secret_counts(findings(spark, sf_dir))


SEMGREP_SEV = ("CASE WHEN lower(coalesce(severity, '')) LIKE '%error%' OR lower(coalesce(severity, '')) LIKE '%high%' "
               "OR lower(coalesce(severity, '')) LIKE '%critical%' THEN 'High' "
               "WHEN lower(coalesce(severity, '')) LIKE '%warning%' OR lower(coalesce(severity, '')) LIKE '%medium%' "
               "THEN 'Medium' ELSE 'Low' END")
TOOL_ROLLUP_SQL = f"""
SELECT scan_id, source AS tool, count(*) AS findings,
       {cnt(f"({SEMGREP_SEV}) = 'High'")} AS high, {cnt(f"({SEMGREP_SEV}) = 'Medium'")} AS medium,
       {cnt(f"({SEMGREP_SEV}) = 'Low'")} AS low
FROM {FIND} GROUP BY scan_id, source
"""


@register("AGG-08", TOOL_ROLLUP_SQL)
def q_agg08(spark, sf_dir):
    return S.tool_rollup(findings(spark, sf_dir))


MERGE_SQL = f"""
WITH s AS ({SEV_SUMMARY_SQL}),
n AS (SELECT * FROM ({TOOL_ROLLUP_SQL}) WHERE tool = 'semgrep'),
u AS (SELECT scan_id, low, moderate, high, critical, unknown FROM s
      UNION ALL SELECT scan_id, low, medium, high, 0, 0 FROM n)
SELECT scan_id, CAST(sum(low) AS BIGINT) AS low, CAST(sum(moderate) AS BIGINT) AS moderate,
       CAST(sum(high) AS BIGINT) AS high, CAST(sum(critical) AS BIGINT) AS critical,
       CAST(sum(unknown) AS BIGINT) AS unknown
FROM u GROUP BY scan_id
"""


@register("AGG-09", MERGE_SQL)
def q_agg09(spark, sf_dir):
    f = findings(spark, sf_dir)
    new = S.tool_rollup(f).filter(F.col("tool") == "semgrep")
    return S.merge_severity(S.severity_summary(f.filter(F.col("kind") == S.VULN)), new)


STATUS_COUNTS_SQL = f"""
SELECT scan_id, {cnt("lower(coalesce(status, 'unknown')) = 'supported'")} AS supported,
       {cnt("lower(coalesce(status, 'unknown')) = 'partial'")} AS partial,
       {cnt("lower(coalesce(status, 'unknown')) = 'unsupported'")} AS unsupported,
       {cnt("lower(coalesce(status, 'unknown')) NOT IN ('supported', 'partial', 'unsupported')")} AS unknown
FROM ({V.V_BASELINE_SQL}) GROUP BY scan_id
"""


@register("AGG-10", STATUS_COUNTS_SQL)
def q_agg10(spark, sf_dir):
    return S.status_counts(V.v_baseline(spark, sf_dir))


COMPAT_ROWS_SQL = f"""
SELECT p.scan_id, p.feature, coalesce(d.status, 'unknown') AS status
FROM (SELECT DISTINCT scan_id, feature FROM ({V.V_FEATURES_SQL}) WHERE feature IS NOT NULL) p
LEFT JOIN {FD} d ON p.feature = d.feature
"""
COMPAT_SQL = f"""
SELECT scan_id, {cnt("status = 'supported'")} AS supported, {cnt("status = 'partial'")} AS partial,
       {cnt("status = 'unsupported'")} AS unsupported,
       coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE status = 'supported')), ','), '') AS supported_features,
       coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE status = 'partial')), ','), '') AS partial_features,
       coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE status = 'unsupported')), ','), '') AS unsupported_features
FROM ({COMPAT_ROWS_SQL}) GROUP BY scan_id
"""


def flags(spark, sf_dir):
    return S.scan_flags(V.v_features(spark, sf_dir), V.v_configs(spark, sf_dir), findings(spark, sf_dir),
                        dims.feature_dim(spark))


RECS = S.RECOMMENDATIONS
FLAGS_SQL = f"""
WITH c AS ({COMPAT_ROWS_SQL}),
f AS (SELECT scan_id,
        max(CASE WHEN feature = 'XMLHttpRequest' THEN 1 ELSE 0 END) AS has_xhr,
        max(CASE WHEN feature = 'fetch' THEN 1 ELSE 0 END) AS has_fetch,
        max(CASE WHEN feature = 'AbortController' THEN 1 ELSE 0 END) AS has_abort,
        max(CASE WHEN feature = 'core-js/features/promise' THEN 1 ELSE 0 END) AS has_promise_polyfill,
        max(CASE WHEN feature = 'async-await' AND status = 'supported' THEN 1 ELSE 0 END) AS aa_supported,
        {cnt("status = 'unsupported'")} AS unsupported
      FROM c GROUP BY scan_id),
fl AS (SELECT scan_id, {cnt("kind = 'missing_policy'")} AS policies, {cnt("kind = 'insecure_api'")} AS insecure,
        max(CASE WHEN kind = 'missing_policy' AND title = 'Rate limiting' THEN 1 ELSE 0 END) AS t_rate,
        max(CASE WHEN kind = 'missing_policy' AND title = 'CSRF' THEN 1 ELSE 0 END) AS t_csrf,
        max(CASE WHEN kind = 'missing_policy' AND title = 'X-Powered-By' THEN 1 ELSE 0 END) AS t_xpb,
        max(CASE WHEN kind = 'missing_policy' AND title IN ('Permissive CORS', 'Permissive CORS with credentials', 'Wildcard CORS headers/methods') THEN 1 ELSE 0 END) AS t_cors,
        max(CASE WHEN kind = 'insecure_api' AND title IN ('Cookie without httpOnly', 'Cookie without secure') THEN 1 ELSE 0 END) AS t_cookie
      FROM {FIND} GROUP BY scan_id),
cf AS (SELECT scan_id, max(CASE WHEN name = 'helmet.config.js' THEN 1 ELSE 0 END) AS has_helmet FROM ({V.V_CONFIGS_SQL}) GROUP BY scan_id)
SELECT coalesce(f.scan_id, fl.scan_id, cf.scan_id) AS scan_id, coalesce(has_helmet, 0) AS has_helmet,
       coalesce(has_xhr, 0) AS has_xhr, coalesce(has_fetch, 0) AS has_fetch, coalesce(has_abort, 0) AS has_abort,
       coalesce(has_promise_polyfill, 0) AS has_promise_polyfill, coalesce(aa_supported, 0) AS aa_supported,
       coalesce(unsupported, 0) AS unsupported, coalesce(policies, 0) AS policies, coalesce(insecure, 0) AS insecure,
       coalesce(t_rate, 0) AS t_rate, coalesce(t_csrf, 0) AS t_csrf, coalesce(t_xpb, 0) AS t_xpb,
       coalesce(t_cors, 0) AS t_cors, coalesce(t_cookie, 0) AS t_cookie
FROM f FULL JOIN fl ON f.scan_id = fl.scan_id FULL JOIN cf ON cf.scan_id = coalesce(f.scan_id, fl.scan_id)
"""
RECS_SQL = f"""
WITH g AS ({FLAGS_SQL})
SELECT scan_id, ord, recommendation FROM (
  SELECT scan_id, 1 AS ord, '{RECS[0]}' AS recommendation FROM g WHERE has_xhr = 1 AND has_fetch = 0
  UNION ALL SELECT scan_id, 2, '{RECS[1]}' FROM g WHERE has_promise_polyfill = 1 AND aa_supported = 1
  UNION ALL SELECT scan_id, 3, '{RECS[2]}' FROM g WHERE has_fetch = 1 AND has_abort = 0
  UNION ALL SELECT scan_id, 4, '{RECS[3]}' FROM g WHERE policies > 0 AND has_helmet = 0
  UNION ALL SELECT scan_id, 5, '{RECS[4]}' FROM g WHERE t_rate = 1
  UNION ALL SELECT scan_id, 6, '{RECS[5]}' FROM g WHERE t_csrf = 1
  UNION ALL SELECT scan_id, 7, '{RECS[6].replace("'", "''")}' FROM g WHERE t_xpb = 1
  UNION ALL SELECT scan_id, 8, '{RECS[7]}' FROM g WHERE t_cors = 1
  UNION ALL SELECT scan_id, 9, '{RECS[8]}' FROM g WHERE t_cookie = 1)
"""


@register("AGG-12", RECS_SQL)
def q_agg12(spark, sf_dir):
    return S.recommendations(flags(spark, sf_dir)).withColumn("ord", F.col("ord"))


AGG11_SQL = f"""
SELECT c.*, coalesce(r.n, 0) AS suggested FROM ({COMPAT_SQL}) c
LEFT JOIN (SELECT scan_id, count(*) AS n FROM ({RECS_SQL}) GROUP BY scan_id) r ON r.scan_id = c.scan_id
"""


@register("AGG-11", AGG11_SQL)
def q_agg11(spark, sf_dir):
    return S.compatibility(V.v_features(spark, sf_dir), dims.feature_dim(spark), S.recommendations(flags(spark, sf_dir)))


FEATURE_USAGE_SQL = f"""
SELECT scan_id, feature, count(DISTINCT file) AS files FROM ({V.V_FEATURES_SQL}) GROUP BY scan_id, feature
"""


@register("AGG-14", FEATURE_USAGE_SQL)
def q_agg14(spark, sf_dir):
    return S.feature_usage(V.v_features(spark, sf_dir))


CAT15A_SQL = f"""
SELECT scan_id, count(*) AS total,
  {cnt("category = 'secure'")} AS secure,
  {cnt("category = 'modernize' OR category IS NULL OR category NOT IN ('secure', 'modernize', 'performance', 'cleanup')")} AS modernize,
  {cnt("category = 'performance'")} AS performance, {cnt("category = 'cleanup'")} AS cleanup
FROM {SUGG} GROUP BY scan_id
"""


@register("AGG-15", CAT15A_SQL)
def q_agg15(spark, sf_dir):
    return S.suggestion_categories(V.v_suggestions(spark, sf_dir), "known")


LC = "lower(coalesce(category, ''))"
CAT15B_SQL = f"""
SELECT scan_id, count(*) AS total,
  {cnt(f"{LC} LIKE '%secure%'")} AS security,
  {cnt(f"{LC} NOT LIKE '%secure%' AND {LC} LIKE '%modernize%'")} AS modernization,
  {cnt(f"{LC} NOT LIKE '%secure%' AND {LC} NOT LIKE '%modernize%' AND {LC} LIKE '%performance%'")} AS performance,
  {cnt(f"{LC} NOT LIKE '%secure%' AND {LC} NOT LIKE '%modernize%' AND {LC} NOT LIKE '%performance%'")} AS maintenance
FROM {SUGG} GROUP BY scan_id
"""


@register("AGG-15b", CAT15B_SQL)
def q_agg15b(spark, sf_dir):
    return S.suggestion_categories(V.v_suggestions(spark, sf_dir), "buckets")


SS = "lower(coalesce(severity, ''))"
SUMMARY16_SQL = f"""
WITH s AS (SELECT scan_id, count(*) AS items, count(DISTINCT coalesce(file, '∅')) AS unique_files,
             CAST(sum(CASE WHEN {SS} LIKE 'high%' THEN 3 WHEN {SS} LIKE 'medium%' THEN 2 WHEN {SS} <> '' THEN 1 ELSE 0 END) AS BIGINT) AS severity_score
           FROM {SUGG} GROUP BY scan_id),
c AS ({COMPAT_SQL}),
fc AS (SELECT scan_id, {cnt("kind IN ('missing_policy', 'insecure_api')")} AS security_findings FROM {FIND} GROUP BY scan_id)
SELECT s.scan_id, items, unique_files, severity_score,
  CAST(CASE WHEN coalesce(c.supported, 0) + coalesce(c.partial, 0) + coalesce(c.unsupported, 0) = 0 THEN 0
       ELSE floor(coalesce(c.supported, 0) * 1.0 / (coalesce(c.supported, 0) + coalesce(c.partial, 0) + coalesce(c.unsupported, 0)) * 100 + 0.5) END AS BIGINT) AS baseline_compliance,
  CAST(least(40, floor(sqrt(items) * 5 + severity_score * 2 + 0.5)) AS BIGINT) AS estimated_improvement,
  CAST(coalesce(fc.security_findings, 0) AS BIGINT) AS security_findings
FROM s LEFT JOIN c ON s.scan_id = c.scan_id LEFT JOIN fc ON s.scan_id = fc.scan_id
"""


@register("AGG-16", SUMMARY16_SQL)
def q_agg16(spark, sf_dir):
    compat = S.compatibility(V.v_features(spark, sf_dir), dims.feature_dim(spark))
    return S.suggestion_summary(V.v_suggestions(spark, sf_dir), compat, findings(spark, sf_dir))


HEAT_SQL = f"""
WITH p AS (
  SELECT scan_id, coalesce(nullif(file, ''), 'unknown') AS file, count(*) AS count,
    CAST(sum((CASE WHEN {SS} LIKE 'high%' THEN 3 WHEN {SS} LIKE 'medium%' THEN 2 ELSE 1 END) *
             (CASE WHEN {LC} LIKE '%secure%' THEN 13 WHEN {LC} LIKE '%performance%' THEN 12
                   WHEN {LC} LIKE '%modernize%' THEN 11 ELSE 10 END)) AS BIGINT) AS score10,
    array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), ',') AS categories
  FROM {SUGG} GROUP BY scan_id, coalesce(nullif(file, ''), 'unknown'))
SELECT scan_id, file, count, score10 / 10.0 AS score, coalesce(categories, '') AS categories,
  CAST(least(100, greatest(1, floor(score10 * 1.0 / (CASE WHEN max(score10) OVER (PARTITION BY scan_id) = 0 THEN 1
       ELSE max(score10) OVER (PARTITION BY scan_id) END) * 100 + 0.5))) AS BIGINT) AS pct
FROM p
"""


@register("AGG-17", HEAT_SQL)
def q_agg17(spark, sf_dir):
    return S.impact_heatmap(V.v_suggestions(spark, sf_dir))


# TOP-02: top 50 vulnerabilities per scan by severity weight, stable by ord.
WEIGHT = ("CASE WHEN ({N}) = 'critical' THEN 4 WHEN ({N}) = 'high' THEN 3 WHEN ({N}) = 'medium' THEN 2 "
          "WHEN ({N}) = 'low' THEN 1 ELSE 0 END").replace("{N}", NSEV)
TOP02_SQL = f"""
SELECT scan_id, ord, title, severity, weight, rank FROM (
  SELECT scan_id, ord, title, severity, {WEIGHT} AS weight,
         row_number() OVER (PARTITION BY scan_id ORDER BY {WEIGHT} DESC, ord ASC) AS rank
  FROM {FIND} WHERE kind = 'vulnerability') WHERE rank <= 50
"""


@register("TOP-02", TOP02_SQL)
def q_top02(spark, sf_dir):
    return T.top_findings(vulns(spark, sf_dir), 50).select(
        "scan_id", "ord", "title", "severity", "weight", F.col("rank").cast("long").alias("rank"))


TOP06_SQL = f"""
SELECT scan_id, source, ord, title FROM (
  SELECT scan_id, source, ord, title, row_number() OVER (PARTITION BY scan_id, source ORDER BY ord) AS rn
  FROM {FIND}) WHERE rn <= 100
"""


@register("TOP-06", TOP06_SQL)
def q_top06(spark, sf_dir):
    return T.first_results(findings(spark, sf_dir), 100).select("scan_id", "source", "ord", "title")


TOP08_SQL = f"""
SELECT scan_id, ord, kind, title, severity,
       CASE WHEN ({NSEV}) IN ('critical', 'high') THEN 3 WHEN ({NSEV}) = 'medium' THEN 2 ELSE 1 END AS weight
FROM {FIND} WHERE kind IN ('insecure_api', 'missing_policy') AND lower(severity) IN ('high', 'medium')
"""


@register("TOP-08", TOP08_SQL)
def q_top08(spark, sf_dir):
    f = S.hygiene_issues(findings(spark, sf_dir))
    return T.sort_issues(f, ["High", "Medium"]).select("scan_id", "ord", "kind", "title", "severity", "weight")


# TOP-05: page 2 (size 10) of each scan's suggestion list ordered by ord.
TOP05_SQL = f"""
SELECT scan_id, ord, title, row, total_pages FROM (
  SELECT scan_id, ord, title, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS row,
         CAST(greatest(1, ceil(count(*) OVER (PARTITION BY scan_id) / 10.0)) AS BIGINT) AS total_pages
  FROM {SUGG}) WHERE row BETWEEN 11 AND 20
"""


@register("TOP-05", TOP05_SQL)
def q_top05(spark, sf_dir):
    s = V.v_suggestions(spark, sf_dir)
    return T.page(s, 2, 10, [F.col("ord")], by=["scan_id"]).select(
        "scan_id", "ord", "title", F.col("row").cast("long").alias("row"), "total_pages")


CI_SUMMARY_SQL = f"""
SELECT scan_id, count(*) AS workflows, {cnt(f"({NSEV}) IN ('critical', 'high')")} AS high,
       {cnt(f"({NSEV}) = 'medium'")} AS medium, {cnt(f"({NSEV}) = 'low'")} AS low
FROM {FIND} WHERE kind = 'ci' GROUP BY scan_id
"""


@register("AGG-23", CI_SUMMARY_SQL)
def q_agg23(spark, sf_dir):
    return S.ci_summary(findings(spark, sf_dir))


RELEASE_SQL = f"""
WITH s AS ({SEV_SUMMARY_SQL}),
x AS (SELECT scan_id, count(*) AS secrets FROM {FIND} WHERE kind = 'secret' GROUP BY scan_id)
SELECT s.scan_id, s.critical + s.high AS critical_high, coalesce(x.secrets, 0) AS secrets,
       (s.critical + s.high > 0 OR coalesce(x.secrets, 0) > 0) AS blocked
FROM s LEFT JOIN x ON s.scan_id = x.scan_id
"""


@register("AGG-24", RELEASE_SQL)
def q_agg24(spark, sf_dir):
    f = findings(spark, sf_dir)
    return S.release_gate(S.severity_summary(f.filter(F.col("kind") == S.VULN)), f, allow_insecure=False)


HYG_FILE_SQL = f"""
WITH i AS (SELECT *, coalesce(file, 'General') AS fkey,
                  CASE WHEN kind = 'missing_policy' THEN 0 ELSE 1 END AS list_ord, {WEIGHT} AS w
           FROM {FIND} WHERE kind IN ('missing_policy', 'insecure_api'))
SELECT scan_id, fkey AS file, count(*) AS count,
       CASE WHEN max(w) > 1 THEN arg_max(severity, (w * 1000000000000 - list_ord * 100000000000 - ord)) ELSE 'Low' END AS max_severity
FROM i GROUP BY scan_id, fkey
"""


@register("AGG-28", HYG_FILE_SQL)
def q_agg28(spark, sf_dir):
    return S.hygiene_by_file(findings(spark, sf_dir))


COMPLIANCE_PCT_SQL = f"""
SELECT scan_id, supported, supported + partial + unsupported AS total,
  CAST(CASE WHEN supported + partial + unsupported = 0 THEN 0
       ELSE floor(supported * 1.0 / (supported + partial + unsupported) * 100 + 0.5) END AS BIGINT) AS pct,
  CASE WHEN pct >= 80 THEN 'brightgreen' WHEN pct >= 60 THEN 'yellow' WHEN pct >= 40 THEN 'orange' ELSE 'red' END AS badge,
  CASE WHEN pct >= 80 THEN 'good' WHEN pct >= 50 THEN 'fair' ELSE 'poor' END AS health
FROM ({COMPAT_SQL})
"""


@register("AGG-33", COMPLIANCE_PCT_SQL)
def q_agg33(spark, sf_dir):
    return S.compliance_pct(S.compatibility(V.v_features(spark, sf_dir), dims.feature_dim(spark)))


# -- repository statistics ------------------------------------------------------------
FILES = f"({V.V_FILES_SQL})"
AGG01_SQL = f"""
SELECT scan_id, count(*) AS files, count(DISTINCT CASE WHEN dir <> '.' THEN dir END) AS folders,
       CAST(sum(len(string_split(coalesce(content, ''), chr(10)))) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS bytes
FROM {FILES} GROUP BY scan_id
"""


@register("AGG-01", AGG01_SQL)
def q_agg01(spark, sf_dir):
    return S.repo_stats(V.v_files(spark, sf_dir))


AGG02_SQL = f"""
SELECT scan_id, ext, count(*) AS files, row_number() OVER (PARTITION BY scan_id ORDER BY count(*) DESC, ext) AS rank
FROM {FILES} WHERE ext <> '' GROUP BY scan_id, ext
"""


@register("AGG-02", AGG02_SQL)
def q_agg02(spark, sf_dir):
    return S.language_histogram(V.v_files(spark, sf_dir))


AGG03_SQL = f"""
WITH b AS (SELECT scan_id, ext, CAST(sum(size) AS BIGINT) AS bytes FROM {FILES} WHERE ext <> '' GROUP BY scan_id, ext)
SELECT scan_id, ext, bytes,
       CAST(CASE WHEN sum(bytes) OVER (PARTITION BY scan_id) = 0 THEN 0
            ELSE floor(bytes * 1.0 / sum(bytes) OVER (PARTITION BY scan_id) * 100 + 0.5) END AS BIGINT) AS pct
FROM b
"""


@register("AGG-03", AGG03_SQL)
def q_agg03(spark, sf_dir):
    return S.language_share(V.v_files(spark, sf_dir))


CORPUS = f"({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL})"
AGG29_SQL = f"""
WITH f AS (SELECT scan_id, path AS src, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM {CORPUS}),
g AS (SELECT scan_id, src, parts, len(parts) AS n, least(len(parts) - 1, 2) AS nd FROM f WHERE len(parts) > 0),
d AS (SELECT scan_id, src, step, array_to_string(parts[1:step], '/') AS parent, parts[step + 1] AS name
      FROM (SELECT scan_id, src, parts, unnest(range(nd)) AS step FROM g)),
dirs AS (SELECT scan_id, parent, name, 'dir' AS type, min(src) AS src, min(step) AS step FROM d GROUP BY scan_id, parent, name),
leaves AS (SELECT scan_id, array_to_string(parts[1:nd], '/') AS parent, parts[n] AS name, 'file' AS type, src, nd AS step FROM g),
ev AS (SELECT * FROM dirs UNION ALL SELECT * FROM leaves),
k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY src, step) AS rn FROM ev)
SELECT scan_id, parent, name, type, CASE WHEN parent = '' THEN 1 ELSE len(string_split(parent, '/')) + 1 END AS depth,
       parent || chr(1) || CASE WHEN type = 'dir' THEN '0' ELSE '1' END || lower(name) || chr(1) || name AS sort_key
FROM k WHERE rn <= 299
"""


@register("AGG-29", AGG29_SQL)
def q_agg29(spark, sf_dir):
    corpus = V.v_files(spark, sf_dir).unionByName(V.v_code(spark, sf_dir))
    return S.file_tree(corpus, 2, 300)


AGG30_SQL = """
WITH a AS (SELECT o_orderpriority AS repo, date_trunc('week', o_orderdate) AS week, count(*) AS total
           FROM orders GROUP BY 1, 2),
r AS (SELECT repo, total, row_number() OVER (PARTITION BY repo ORDER BY week DESC) AS rn FROM a),
m AS (SELECT repo, CAST(floor(avg(total) + 0.5) AS BIGINT) AS commits_per_week FROM r WHERE rn <= 4 GROUP BY repo),
c AS (SELECT o_orderpriority AS repo, count(DISTINCT CAST(o_custkey AS VARCHAR)) AS contributors FROM orders GROUP BY 1)
SELECT coalesce(m.repo, c.repo) AS repo, commits_per_week, contributors FROM m FULL JOIN c ON m.repo = c.repo
"""


@register("AGG-30", AGG30_SQL)
def q_agg30(spark, sf_dir):
    return S.commit_frequency(V.v_activity(spark, sf_dir), V.v_contributors(spark, sf_dir), 4)


LOWMSG = "lower(coalesce(msg, ''))"
AGG32_SQL = f"""
SELECT scan_id, CASE WHEN contains({LOWMSG}, 'error') OR contains({LOWMSG}, 'fail') THEN 'error'
                     WHEN contains({LOWMSG}, 'warn') THEN 'warn'
                     WHEN contains({LOWMSG}, 'done') OR contains({LOWMSG}, 'complete') OR contains({LOWMSG}, 'success') THEN 'success'
                     ELSE 'info' END AS level, count(*) AS lines
FROM ({V.V_LOGS_SQL}) GROUP BY 1, 2
"""


@register("AGG-32", AGG32_SQL)
def q_agg32(spark, sf_dir):
    return S.log_levels(V.v_logs(spark, sf_dir))


TOP07_SQL = f"""
SELECT scan_id, path, size, rank FROM (
  SELECT scan_id, path, size, row_number() OVER (PARTITION BY scan_id ORDER BY size DESC, path) AS rank FROM {FILES})
WHERE rank <= 10
"""


@register("TOP-07", TOP07_SQL)
def q_top07(spark, sf_dir):
    return T.largest_files(V.v_files(spark, sf_dir), 10).select("scan_id", "path", "size",
                                                                F.col("rank").cast("long").alias("rank"))


TOP09_SQL = f"""
SELECT scan_id, file, features, n_features FROM (
  SELECT scan_id, file, array_to_string(list_sort(list(DISTINCT feature)), ', ') AS features,
         count(DISTINCT feature) AS n_features, row_number() OVER (PARTITION BY scan_id ORDER BY file) AS rn
  FROM ({V.V_FEATURES_SQL}) GROUP BY scan_id, file) WHERE rn <= 40
"""


@register("TOP-09", TOP09_SQL)
def q_top09(spark, sf_dir):
    return T.file_features(V.v_features(spark, sf_dir), 40)


SCANS = f"({V.V_SCANS_SQL})"
TOP03_SQL = f"""
SELECT id, repo_url, status, created_at FROM {SCANS} ORDER BY created_at DESC, id LIMIT 20
"""


@register("TOP-03", TOP03_SQL)
def q_top03(spark, sf_dir):
    return T.latest_scans(V.v_scans(spark, sf_dir), 20).select("id", "repo_url", "status", "created_at")
