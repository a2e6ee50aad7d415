"""Queries: dimension joins, section joins and composite scores over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import dims, rules
from codelens.operators import joins as J
from codelens.operators import score as S
from codelens.plans import bindings as V
from codelens.plans.catalog import register
from codelens.plans.q_scores import COMPAT_SQL, FIND, NSEV, RECS_SQL, SEV_SUMMARY_SQL, WEIGHT, cnt, flags

DEPS = f"({V.V_DEPS_SQL})"
OUTD = f"({V.V_OUTDATED_SQL})"
NAMES = f"({V.V_NAMES_SQL})"
FILES = f"({V.V_FILES_SQL})"

JOIN05_SQL = f"""
SELECT d.scan_id, d.package_dir, d.name, d.version, d.dev, d.ord, o.current, o.latest,
       CASE WHEN o.latest IS NOT NULL AND o.current <> o.latest THEN 'Outdated' ELSE 'OK' END AS status
FROM {DEPS} d LEFT JOIN {OUTD} o ON d.scan_id = o.scan_id AND d.name = o.name
"""


@register("JOIN-05", JOIN05_SQL)
def q_join05(spark, sf_dir):
    return J.dependency_status(V.v_deps(spark, sf_dir), V.v_outdated(spark, sf_dir))


PKG_VALUES = ", ".join(f"('{f}', '{p}')" for f, p in J.FRAMEWORK_PACKAGES)
JOIN06_SQL = f"""
WITH fw AS (SELECT scan_id, name FROM ({V.V_FRAMEWORKS_SQL})),
pk AS (SELECT * FROM (VALUES {PKG_VALUES}) AS t(framework, package)),
first AS (SELECT scan_id, lower(name) AS package, arg_min(version, ord) AS version
          FROM (SELECT scan_id, name, version, ord FROM {DEPS} UNION ALL SELECT scan_id, name, version, ord FROM ({V.V_PACKAGES_SQL})) GROUP BY scan_id, lower(name)),
f AS (SELECT fw.scan_id, fw.name AS framework, coalesce(pk.package, lower(fw.name)) AS package
      FROM fw LEFT JOIN pk ON fw.name = pk.framework)
SELECT f.scan_id, f.framework, f.package, coalesce(first.version, '') AS version
FROM f LEFT JOIN first ON f.scan_id = first.scan_id AND f.package = first.package
"""


@register("JOIN-06", JOIN06_SQL)
def q_join06(spark, sf_dir):
    fw = V.v_frameworks(spark, sf_dir)
    pk = spark.createDataFrame(J.FRAMEWORK_PACKAGES, "framework string, package string")
    return J.framework_versions(fw, V.v_deps(spark, sf_dir).unionByName(V.v_packages(spark, sf_dir)), pk)


JOIN12_SQL = f"""
WITH a AS ({V.V_ALLOWED_SQL})
SELECT scan_id, name FROM ({V.V_FRAMEWORKS_SQL}) f
WHERE EXISTS (SELECT 1 FROM a WHERE a.scan_id = f.scan_id AND a.name = f.name) OR NOT EXISTS (SELECT 1 FROM a WHERE a.scan_id = f.scan_id)
"""


@register("JOIN-12", JOIN12_SQL)
def q_join12(spark, sf_dir):
    return J.apply_allow_list(V.v_frameworks(spark, sf_dir), V.v_allowed(spark, sf_dir), enforce=True)


# JOIN-13: router names (languages / frameworks) through the evaluation gate.
TECH_VALUES = ", ".join(f"('{n}', {str(a).lower()}, '{s}', '{t}')" for n, a, s, t in rules.TECH_EVALUATION)


def _join13_sql():
    from codelens.plans.q_diff import ROUTER_SQL
    return f"""
WITH r AS (SELECT scan_id, name FROM ({ROUTER_SQL})),
t AS (SELECT * FROM (VALUES {TECH_VALUES}) AS v(name, approved, status, testing_level))
SELECT r.scan_id, r.name, coalesce(t.testing_level, 'smoke') AS testing_level
FROM r LEFT JOIN t ON r.name = t.name
WHERE (t.status IS NULL AND t.approved IS NULL) OR (lower(coalesce(t.status, '')) <> 'inactive' AND coalesce(t.approved, false))
"""


@register("JOIN-13", _join13_sql())
def q_join13(spark, sf_dir):
    from codelens.plans.q_diff import router
    r = router(spark, sf_dir).select("scan_id", "name")
    return J.apply_tech_gate(r, dims.tech_dim(spark), enforce=True)


JOIN14_SQL = f"""
WITH s AS (SELECT DISTINCT scan_id FROM ({V.V_FEATURES_SQL}))
SELECT scan_id, name FROM s, (VALUES ('.browserslistrc'), ('postcss.config.js'), ('babel.config.js')) AS t(name)
WHERE NOT EXISTS (SELECT 1 FROM ({V.V_CONFIGS_SQL}) c WHERE c.scan_id = s.scan_id AND c.name = t.name)
"""


@register("JOIN-14", JOIN14_SQL)
def q_join14(spark, sf_dir):
    f = V.v_features(spark, sf_dir)
    return J.missing_configs(V.v_configs(spark, sf_dir), f, f.select("scan_id"))


JOIN15_SQL = f"""
SELECT scan_id, path, size FROM {FILES} f
WHERE EXISTS (SELECT 1 FROM ({V.V_CHANGED_SQL}) c WHERE c.scan_id = f.scan_id AND c.path = f.path)
"""


@register("JOIN-15", JOIN15_SQL)
def q_join15(spark, sf_dir):
    return J.changed_files(V.v_files(spark, sf_dir), V.v_changed(spark, sf_dir)).select("scan_id", "path", "size")


def _remedy_case(idx):
    whens = []
    for parts, lab, k in J.REMEDIATION_RULES:
        cond = " OR ".join(f"contains(coalesce(title, ''), '{p}')" for p in parts)
        whens.append(f"WHEN {cond} THEN '{(lab, k)[idx]}'")
    return "CASE " + " ".join(whens) + " END"


JOIN16_SQL = f"""
SELECT scan_id, ord, title, {_remedy_case(0)} AS remedy, {_remedy_case(1)} AS snippet
FROM {FIND} WHERE kind IN ('missing_policy', 'insecure_api')
"""


@register("JOIN-16", JOIN16_SQL)
def q_join16(spark, sf_dir):
    f = V.v_findings(spark, sf_dir).filter(F.col("kind").isin(S.POLICY, S.INSECURE))
    return J.remediation(f).select("scan_id", "ord", "title", "remedy", "snippet")


SCANS = f"({V.V_SCANS_SQL})"
JOIN17_SQL = f"""
SELECT id, CASE WHEN status = 'done' THEN status ELSE 'processing' END AS status,
       CASE WHEN status = 'done' THEN 0 ELSE 1 END AS source_prio
FROM {SCANS}
"""


@register("JOIN-17", JOIN17_SQL)
def q_join17(spark, sf_dir):
    s = V.v_scans(spark, sf_dir).select("id", "status")
    stored = s.filter(F.col("status") == "done")
    live = s.select("id", F.lit("processing").alias("status"))
    return J.latest_snapshot(stored, live, "id")


# -- composite scores ---------------------------------------------------------------
MISSING_SQL = JOIN14_SQL
SUGG = f"({V.V_SUGGESTIONS_SQL})"
VP = ("CASE WHEN ({N}) = 'critical' THEN 20 WHEN ({N}) = 'high' THEN 10 WHEN ({N}) = 'medium' THEN 5 "
      "WHEN ({N}) = 'low' THEN 2 ELSE 0 END").replace("{N}", NSEV)
AGG18_SQL = f"""
WITH m AS (
  SELECT scan_id, 'vuln_points' AS measure, CAST(CASE WHEN kind = 'vulnerability' THEN {VP} ELSE 0 END AS DOUBLE) AS value FROM {FIND}
  UNION ALL SELECT scan_id, 'policies', CAST(kind = 'missing_policy' AS INTEGER) FROM {FIND}
  UNION ALL SELECT scan_id, 'insecure', CAST(kind = 'insecure_api' AS INTEGER) FROM {FIND}
  UNION ALL SELECT scan_id, 'unsupported', unsupported FROM ({COMPAT_SQL})
  UNION ALL SELECT scan_id, 'missing_configs', 1 FROM ({MISSING_SQL})
  UNION ALL SELECT scan_id, 'secure_high', CAST(lower(coalesce(severity, '')) = 'high' AND category = 'secure' AS INTEGER) FROM {SUGG}),
f AS (SELECT scan_id,
        coalesce(sum(value) FILTER (WHERE measure = 'vuln_points'), 0) AS vuln_points,
        coalesce(sum(value) FILTER (WHERE measure = 'policies'), 0) AS policies,
        coalesce(sum(value) FILTER (WHERE measure = 'insecure'), 0) AS insecure,
        coalesce(sum(value) FILTER (WHERE measure = 'unsupported'), 0) AS unsupported,
        coalesce(sum(value) FILTER (WHERE measure = 'missing_configs'), 0) AS missing_configs,
        coalesce(sum(value) FILTER (WHERE measure = 'secure_high'), 0) AS secure_high
      FROM m GROUP BY scan_id)
SELECT scan_id, CAST(vuln_points AS BIGINT) AS vuln_points, CAST(policies AS BIGINT) AS policies,
       CAST(insecure AS BIGINT) AS insecure, CAST(unsupported AS BIGINT) AS unsupported,
       CAST(missing_configs AS BIGINT) AS missing_configs, CAST(secure_high AS BIGINT) AS secure_high,
       CAST(least(100, greatest(0, floor(vuln_points + 3 * policies + 3 * insecure + unsupported + missing_configs
            + 5 * secure_high + 0.5 * least(unsupported, 50) + 0.5))) AS BIGINT) AS risk
FROM f
"""


def compat(spark, sf_dir):
    return S.compatibility(V.v_features(spark, sf_dir), dims.feature_dim(spark))


def risk(spark, sf_dir):
    f = V.v_features(spark, sf_dir)
    missing = J.missing_configs(V.v_configs(spark, sf_dir), f, f.select("scan_id"))
    return S.risk_score(V.v_findings(spark, sf_dir), compat(spark, sf_dir), missing, V.v_suggestions(spark, sf_dir))


register("AGG-18", AGG18_SQL)(risk)

AGG19_SQL = f"""
WITH s AS ({SEV_SUMMARY_SQL}), c AS ({COMPAT_SQL}),
f AS (SELECT coalesce(s.scan_id, c.scan_id) AS scan_id, coalesce(low, 0) AS low, coalesce(moderate, 0) AS moderate,
             coalesce(high, 0) AS high, coalesce(critical, 0) AS critical, coalesce(unsupported, 0) AS unsupported
      FROM s FULL JOIN c ON s.scan_id = c.scan_id),
g AS (SELECT *, low + moderate + high + critical AS total,
        CASE WHEN low + moderate + high + critical > 0 THEN (high + critical) * 1.0 / (low + moderate + high + critical) ELSE 0 END AS ratio
      FROM f),
h AS (SELECT *, CASE WHEN ratio > 0.25 THEN 'increasing' WHEN ratio < 0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM g)
SELECT scan_id, CAST(least(100, greatest(0, floor(5 * low + 10 * moderate + 20 * high + 30 * critical + 0.5))) AS BIGINT) AS risk,
       trend, CAST(floor(3 * unsupported + 0.5) AS BIGINT) AS projected_debt,
       array_to_string(list_filter([
         CASE WHEN critical > 0 THEN 'Prioritize critical vulnerabilities with immediate patches' END,
         CASE WHEN high > 5 THEN 'Address high-severity issues within one sprint' END,
         CASE WHEN unsupported > 0 THEN 'Refactor unsupported code paths and add polyfills where needed' END,
         CASE WHEN trend = 'increasing' THEN 'Increase test coverage and enable stricter CI checks' END], lambda x: x IS NOT NULL), chr(10)) AS recommendations
FROM h
"""


@register("AGG-19", AGG19_SQL)
def q_agg19(spark, sf_dir):
    f = V.v_findings(spark, sf_dir)
    sev = S.severity_summary(f.filter(F.col("kind") == S.VULN))
    return S.predictive_risk(sev, compat(spark, sf_dir), f)


STANDARDS = "SOC2,ISO27001,GDPR"
AGG20_SQL = f"""
WITH f AS (SELECT scan_id, {cnt("kind = 'vulnerability'")} AS vulns, {cnt("kind = 'missing_policy'")} AS policies FROM {FIND} GROUP BY scan_id),
c AS ({COMPAT_SQL}),
r AS (SELECT scan_id, array_to_string(list(recommendation ORDER BY ord)[1:20], chr(10)) AS recommendations FROM ({RECS_SQL}) GROUP BY scan_id),
b AS (SELECT coalesce(f.scan_id, c.scan_id) AS scan_id, coalesce(vulns, 0) + coalesce(policies, 0) AS base_findings,
             coalesce(unsupported, 0) AS unsupported, coalesce(policies, 0) AS missing_policies,
             (SELECT count(*) FROM ({V.V_LARGE_SQL}) l WHERE l.scan_id = coalesce(f.scan_id, c.scan_id)) AS large
      FROM f FULL JOIN c ON f.scan_id = c.scan_id)
SELECT b.scan_id, CAST(base_findings AS BIGINT) AS base_findings, CAST(unsupported AS BIGINT) AS unsupported,
       CAST(missing_policies AS BIGINT) AS missing_policies, CAST(large AS BIGINT) AS large_assets,
       coalesce(r.recommendations, '') AS recommendations,
       CASE WHEN base_findings + unsupported > 0 THEN 'attention' ELSE 'pass' END AS status, s.standard
FROM b LEFT JOIN r ON b.scan_id = r.scan_id, (VALUES ('SOC2'), ('ISO27001'), ('GDPR')) AS s(standard)
"""


@register("AGG-20", AGG20_SQL)
def q_agg20(spark, sf_dir):
    return S.compliance_report(V.v_findings(spark, sf_dir), compat(spark, sf_dir), S.recommendations(flags(spark, sf_dir)),
                               V.v_large(spark, sf_dir), STANDARDS)


JOIN20_SQL = f"""
SELECT s.id, s.status, t.standard FROM ({V.V_SCANS_SQL}) s, (VALUES ('SOC2'), ('PCI')) AS t(standard)
"""


@register("JOIN-20", JOIN20_SQL)
def q_join20(spark, sf_dir):
    """Every scan of the history with every requested standard (the list has spaces and an empty entry)."""
    s = V.v_scans(spark, sf_dir).select(F.col("id").alias("scan_id"), "status")
    return J.scan_standards(s, " SOC2,,PCI ").select(F.col("scan_id").alias("id"), "status", "standard")


def tool_runs(spark, sf_dir):
    """Tool runs derived from the findings: a tool ran ('ok') when it produced findings."""
    f = V.v_findings(spark, sf_dir)
    return f.groupBy("scan_id", F.col("source").alias("tool")).agg(F.count(F.lit(1)).alias("findings")).withColumn(
        "status", F.lit("ok"))


B_ = "(CASE WHEN (" + NSEV + ") = 'unknown' THEN 'low' ELSE (" + NSEV + ") END)"
def _top_sql(cond: str) -> str:
    """The 50 most severe findings of each scan as lines."""
    return f"""SELECT scan_id, string_agg('[' || coalesce(severity, 'unknown') || '] ' || coalesce(title, ''), chr(10) ORDER BY rank) AS t FROM (
      SELECT scan_id, severity, title, row_number() OVER (PARTITION BY scan_id ORDER BY {WEIGHT} DESC, ord) AS rank FROM {FIND} WHERE {cond})
      WHERE rank <= 50 GROUP BY scan_id"""


AGG21_SQL = f"""
WITH f AS (SELECT scan_id,
  {cnt("kind = 'vulnerability' AND " + B_ + " = 'critical'")} AS v_critical, {cnt("kind = 'vulnerability' AND " + B_ + " = 'high'")} AS v_high,
  {cnt("kind = 'vulnerability' AND " + B_ + " = 'medium'")} AS v_medium, {cnt("kind = 'vulnerability' AND " + B_ + " = 'low'")} AS v_low,
  {cnt("kind IN ('missing_policy', 'insecure_api') AND " + B_ + " = 'critical'")} AS h_critical,
  {cnt("kind IN ('missing_policy', 'insecure_api') AND " + B_ + " = 'high'")} AS h_high,
  {cnt("kind IN ('missing_policy', 'insecure_api') AND " + B_ + " = 'medium'")} AS h_medium,
  {cnt("kind IN ('missing_policy', 'insecure_api') AND " + B_ + " = 'low'")} AS h_low,
  {cnt("kind = 'ci'")} AS ci_workflows, {cnt("kind = 'ci' AND (" + NSEV + ") IN ('critical', 'high')")} AS ci_high,
  {cnt("kind = 'ci' AND (" + NSEV + ") = 'medium'")} AS ci_medium, {cnt("kind = 'ci' AND (" + NSEV + ") = 'low'")} AS ci_low,
  {cnt("source = 'semgrep'")} AS n_semgrep, max(CASE WHEN source = 'npm-audit' THEN 1 ELSE 0 END) AS has_npm
  FROM {FIND} GROUP BY scan_id),
c AS ({COMPAT_SQL})
SELECT f.scan_id, v_critical, v_high, v_medium, v_low, h_critical, h_high, h_medium, h_low,
       ci_workflows, ci_high, ci_medium, ci_low, CAST(coalesce(c.unsupported, 0) AS BIGINT) AS unsupported,
       CASE WHEN n_semgrep > 0 THEN 'ok' ELSE 'not_executed' END AS tool_semgrep,
       CASE WHEN has_npm = 1 THEN 'ok' ELSE 'not_executed' END AS tool_npm, 'not_executed' AS tool_owasp_dependency_check, 'not_executed' AS tool_safety,
       CAST(n_semgrep AS BIGINT) AS semgrep_findings,
       coalesce((SELECT array_to_string(list_sort(list(DISTINCT name)), ',') FROM ({V.V_FRAMEWORKS_SQL}) w WHERE w.scan_id = f.scan_id), '') AS frameworks,
       coalesce(tv.t, '') AS top_vulnerabilities, coalesce(th.t, '') AS top_hygiene
FROM f LEFT JOIN c ON f.scan_id = c.scan_id
LEFT JOIN ({_top_sql("kind = 'vulnerability'")}) tv ON tv.scan_id = f.scan_id
LEFT JOIN ({_top_sql("kind IN ('missing_policy', 'insecure_api')")}) th ON th.scan_id = f.scan_id
"""


@register("AGG-21", AGG21_SQL)
def q_agg21(spark, sf_dir):
    return S.sast_report(V.v_findings(spark, sf_dir), compat(spark, sf_dir), tool_runs(spark, sf_dir), V.v_frameworks(spark, sf_dir))


AGG22_SQL = f"""
WITH s AS (SELECT * FROM {FIND} WHERE kind = 'secret' OR (kind = 'vulnerability' AND
             regexp_matches(coalesce(nullif(title, ''), description, ''), '(?i)(secret|credential|token|key)'))),
b AS (SELECT scan_id, {cnt("(CASE WHEN (" + NSEV + ") = 'unknown' THEN 'low' ELSE (" + NSEV + ") END) = 'critical'")} AS critical,
        {cnt("(CASE WHEN (" + NSEV + ") = 'unknown' THEN 'low' ELSE (" + NSEV + ") END) = 'high'")} AS high,
        {cnt("(CASE WHEN (" + NSEV + ") = 'unknown' THEN 'low' ELSE (" + NSEV + ") END) = 'medium'")} AS medium,
        {cnt("(CASE WHEN (" + NSEV + ") = 'unknown' THEN 'low' ELSE (" + NSEV + ") END) = 'low'")} AS low
      FROM s GROUP BY scan_id),
t AS (SELECT scan_id, count(*) AS n FROM {FIND} WHERE source = 'trufflehog' GROUP BY scan_id)
SELECT b.scan_id, critical, high, medium, low, critical + high + medium + low AS total,
       CASE WHEN t.n IS NULL THEN 'not_executed' ELSE 'ok' END AS trufflehog_status,
       'not_executed' AS gitleaks_status, 'not_executed' AS detect_secrets_status,
       CAST(coalesce(t.n, 0) AS BIGINT) AS trufflehog_findings, coalesce(ts.t, '') AS top_secrets
FROM b LEFT JOIN t ON b.scan_id = t.scan_id
LEFT JOIN ({_top_sql("kind = 'secret' OR (kind = 'vulnerability' AND regexp_matches(coalesce(nullif(title, ''), description, ''), '(?i)(secret|credential|token|key)'))")}) ts
  ON ts.scan_id = b.scan_id
"""


@register("AGG-22", AGG22_SQL)
def q_agg22(spark, sf_dir):
    return S.secrets_report(V.v_findings(spark, sf_dir), tool_runs(spark, sf_dir))


AGG26_SQL = f"""
WITH a AS (SELECT scan_id, count(*) AS scanned FROM {FILES} GROUP BY scan_id),
c AS (SELECT scan_id, count(*) AS changed FROM ({JOIN15_SQL}) GROUP BY scan_id)
SELECT a.scan_id, CAST(scanned AS BIGINT) AS scanned, CAST(coalesce(changed, 0) AS BIGINT) AS changed,
       CAST(floor(coalesce(changed, 0) * 1.0 / scanned * 100 + 0.5) AS BIGINT) AS impact
FROM a LEFT JOIN c ON a.scan_id = c.scan_id
"""


@register("AGG-26", AGG26_SQL)
def q_agg26(spark, sf_dir):
    return S.scan_impact(V.v_files(spark, sf_dir), V.v_changed(spark, sf_dir))


AGG27_SQL = f"""
WITH a AS (SELECT scan_id, count(DISTINCT file) AS scanned FROM ({V.V_FEATURES_SQL}) GROUP BY scan_id),
f AS (SELECT scan_id, {cnt("kind = 'vulnerability'")} AS vulns, {cnt("kind = 'insecure_api'")} AS insecure,
        {cnt("kind = 'missing_policy'")} AS policies, {cnt("kind = 'secret'")} AS secrets,
        {cnt("kind = 'vulnerability' AND (" + NSEV + ") = 'critical'")} AS critical FROM {FIND} GROUP BY scan_id),
j AS (SELECT coalesce(a.scan_id, f.scan_id) AS scan_id, coalesce(scanned, 0) AS scanned, coalesce(vulns, 0) AS vulns,
        coalesce(insecure, 0) AS insecure, coalesce(policies, 0) AS policies, coalesce(secrets, 0) AS secrets,
        coalesce(critical, 0) AS critical FROM a FULL JOIN f ON a.scan_id = f.scan_id)
SELECT scan_id, CAST(scanned AS BIGINT) AS files_scanned, CAST(0 AS BIGINT) AS files_ignored,
       CAST(vulns + insecure + policies + secrets AS BIGINT) AS issues_found, CAST(vulns AS BIGINT) AS vulnerabilities,
       CAST(policies + insecure AS BIGINT) AS hygiene_issues, CAST(secrets AS BIGINT) AS secrets_found,
       array_to_string(list_filter([CASE WHEN critical > 0 THEN CAST(critical AS VARCHAR) || ' critical vulnerabilities detected' END,
         CASE WHEN policies > 0 THEN 'Missing security policies' END,
         CASE WHEN insecure > 0 THEN 'Insecure API calls detected' END], lambda x: x IS NOT NULL), chr(10)) AS warnings
FROM j
"""


@register("AGG-27", AGG27_SQL)
def q_agg27(spark, sf_dir):
    files = V.v_features(spark, sf_dir).select("scan_id", "file").distinct()
    return S.scan_statistics(files, files, V.v_findings(spark, sf_dir))


AGG34_SQL = f"""
WITH r AS ({AGG18_SQL}),
s AS (SELECT scan_id, count(*) AS items,
        {cnt("category = 'secure'")} AS c_secure,
        {cnt("category NOT IN ('secure', 'performance', 'cleanup') OR category IS NULL")} AS c_modernize,
        {cnt("category = 'performance'")} AS c_performance, {cnt("category = 'cleanup'")} AS c_cleanup
      FROM {SUGG} GROUP BY scan_id),
v AS (SELECT scan_id, count(*) AS vulns, {cnt("lower(coalesce(severity, '')) = 'critical'")} AS s_critical,
        {cnt("lower(coalesce(severity, '')) = 'high'")} AS s_high, {cnt("lower(coalesce(severity, '')) = 'medium'")} AS s_medium,
        {cnt("lower(coalesce(severity, '')) = 'low'")} AS s_low FROM {FIND} WHERE kind = 'vulnerability' GROUP BY scan_id),
j AS (SELECT coalesce(r.scan_id, s.scan_id, v.scan_id) AS scan_id, coalesce(risk, 0) AS risk, coalesce(items, 0) AS items,
        coalesce(c_secure, 0) AS c_secure, coalesce(c_modernize, 0) AS c_modernize, coalesce(c_performance, 0) AS c_performance,
        coalesce(c_cleanup, 0) AS c_cleanup, coalesce(vulns, 0) AS vulns, coalesce(s_critical, 0) AS s_critical,
        coalesce(s_high, 0) AS s_high, coalesce(s_medium, 0) AS s_medium, coalesce(s_low, 0) AS s_low
      FROM r FULL JOIN s ON r.scan_id = s.scan_id FULL JOIN v ON coalesce(r.scan_id, s.scan_id) = v.scan_id)
SELECT scan_id, 'Modernization Risk Score: ' || CAST(risk AS VARCHAR) || '/100' || chr(10) ||
  'Changes planned: ' || CAST(items AS VARCHAR) || ' suggestions — security=' || CAST(c_secure AS VARCHAR) ||
  ', modernization=' || CAST(c_modernize AS VARCHAR) || ', performance=' || CAST(c_performance AS VARCHAR) ||
  ', maintenance=' || CAST(c_cleanup AS VARCHAR) || '.' ||
  CASE WHEN vulns > 0 THEN chr(10) || 'Detected vulnerabilities — critical=' || CAST(s_critical AS VARCHAR) ||
       ', high=' || CAST(s_high AS VARCHAR) || ', medium=' || CAST(s_medium AS VARCHAR) || ', low=' || CAST(s_low AS VARCHAR) || '.'
       ELSE '' END AS narrative
FROM j
"""


@register("AGG-34", AGG34_SQL)
def q_agg34(spark, sf_dir):
    f = V.v_findings(spark, sf_dir)
    return S.change_narrative(risk(spark, sf_dir), V.v_suggestions(spark, sf_dir), f.filter(F.col("kind") == S.VULN))
