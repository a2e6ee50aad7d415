"""Queries: reports (SNK-01..04) with all their sections, over the findings,
features, dependencies, names and statistics of the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import dims
from codelens.operators import joins as J
from codelens.operators import score as S
from codelens.plans import bindings as V
from codelens.plans.catalog import QUERIES, register
from codelens.plans.q_joins import AGG27_SQL, JOIN05_SQL, JOIN06_SQL, JOIN14_SQL
from codelens.plans.q_scores import COMPAT_ROWS_SQL, RECS_SQL, flags
from codelens.sources import sinks as K

FIND = f"({V.V_FINDINGS_SQL})"
PERF = ["Blocking I/O", "Dynamic code execution"]
GENERATED_AT = "2024-02-01T00:00:00.000Z"


def scans(spark, sf_dir):
    ids = V.v_findings(spark, sf_dir).select("scan_id").distinct()
    return ids.withColumn("repo_url", F.concat(F.lit("https://example.org/org/"), F.col("scan_id")))


SCANS_SQL = f"SELECT scan_id, 'https://example.org/org/' || scan_id AS repo_url FROM (SELECT DISTINCT scan_id FROM {FIND})"


LISTED = {"supported": "supported_feature", "partial": "partial_feature", "unsupported": "unsupported_item"}


def _by_status(names: dict[str, str]):
    topic = F.lit(None).cast("string")
    for status, name in names.items():
        topic = F.when(F.col("status") == status, name).otherwise(topic)
    return topic.alias("topic")


def facts(spark, sf_dir):
    """Everything that the CSV and Markdown reports show, long form: one or two
    branches per source table, which a report that does not show a topic never computes."""
    features, dim = V.v_features(spark, sf_dir), dims.feature_dim(spark)
    classes = S.compat_classes(features, dim)
    recs = S.recommendations(flags(spark, sf_dir))
    findings = V.v_findings(spark, sf_dir)
    times = V.table(spark, sf_dir, "events").groupBy(V._pick(V.SCANS, F.col("user_id") % 3).alias("scan_id")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))
    with_feature = features.filter(F.col("feature").isNotNull()).select("scan_id", "file")
    stats = S.scan_statistics(features.select("scan_id", "file").distinct(), with_feature.distinct(), findings)
    deps = J.dependency_status(V.v_deps(spark, sf_dir), V.v_outdated(spark, sf_dir))
    told = findings.filter(F.col("kind").isin(S.INSECURE, S.POLICY))
    return K.report_facts([
        K.topics_of(scans(spark, sf_dir), {"repo": F.concat(F.lit("org/"), F.col("scan_id"))}),
        K.topics_of(times, {"started": F.col("first"), "completed": F.col("last"), "scan_date": F.col("last")}),
        classes.groupBy("scan_id", "status").agg(F.count(F.lit(1)).alias("name")).select("scan_id", _by_status({s: s for s in LISTED}), "name"),
        classes.select("scan_id", _by_status(LISTED), F.col("feature").alias("name")),
        K.topics_of(recs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")), {"suggested": F.col("n")}),
        recs.select("scan_id", F.lit("recommendation").alias("topic"), F.col("recommendation").alias("name"), "ord"),
        QUERIES["JOIN-14"](spark, sf_dir).select("scan_id", F.lit("missing_config").alias("topic"), "name"),
        QUERIES["JOIN-06"](spark, sf_dir).select("scan_id", F.lit("framework").alias("topic"), F.col("framework").alias("name"),
                                                 F.col("version").alias("value")),
        deps.select("scan_id", F.lit("dependency").alias("topic"), "name", F.concat("version", F.lit(" ("), "status", F.lit(")")).alias("value"), "ord"),
        V.v_outdated(spark, sf_dir).filter("current <> latest").select(
            "scan_id", F.lit("upgrade").alias("topic"), "name", F.concat("current", F.lit(" -> "), "latest").alias("value")),
        told.select("scan_id", F.when(F.col("title").isin(PERF), "performance").otherwise("security").alias("topic"),
                    F.col("title").alias("name"), F.col("description").alias("value"), "ord"),
        V.v_names(spark, sf_dir).filter(F.col("kind") == "configFiles").select("scan_id", F.lit("config_file").alias("topic"), "name"),
        K.topics_of(stats, {c: F.col(c) for c in ("files_scanned", "files_ignored", "issues_found")},
                    {"warning": F.filter(F.split("warnings", "\n"), lambda w: w != "")}),
    ])


_PERF = ", ".join(f"'{p}'" for p in PERF)
_TIMES = (f"SELECT ({V.sql_list(V.SCANS)})[CAST(user_id % 3 AS INTEGER) + 1] AS scan_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, "
          f"strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
# files with a feature count as analysed
_STATS = AGG27_SQL.replace("CAST(0 AS BIGINT) AS files_ignored", "CAST(greatest(0, scanned - coalesce((SELECT count(DISTINCT x.file) FROM "
                           f"({V.V_FEATURES_SQL}) x WHERE x.scan_id = j.scan_id AND x.feature IS NOT NULL), 0)) AS BIGINT) AS files_ignored")


def _topic(topic: str, sql: str, name: str, value: str = "NULL", ord_: str = "0") -> str:
    return (f"SELECT scan_id, '{topic}' AS topic, CAST({ord_} AS BIGINT) AS ord, CAST({name} AS VARCHAR) AS name, CAST({value} AS VARCHAR) AS value "
            f"FROM ({sql})")


_TOLD = f"SELECT scan_id, ord, title, description FROM {FIND} WHERE kind IN ('insecure_api', 'missing_policy')"
FACTS_SQL = "\nUNION ALL ".join(
    [_topic("repo", SCANS_SQL, "'org/' || scan_id"), _topic("started", _TIMES, "first"), _topic("completed", _TIMES, "last"),
     _topic("scan_date", _TIMES, "last")]
    + [_topic(c, f"SELECT scan_id, count(*) AS n FROM ({COMPAT_ROWS_SQL}) WHERE status = '{c}' GROUP BY scan_id", "n")
       for c in ("supported", "partial", "unsupported")]
    + [_topic(t, f"SELECT scan_id, feature FROM ({COMPAT_ROWS_SQL}) WHERE status = '{c}'", "feature")
       for c, t in (("supported", "supported_feature"), ("partial", "partial_feature"), ("unsupported", "unsupported_item"))]
    + [_topic("suggested", f"SELECT scan_id, count(*) AS n FROM ({RECS_SQL}) GROUP BY scan_id", "n"),
       _topic("recommendation", RECS_SQL, "recommendation", ord_="ord"), _topic("missing_config", JOIN14_SQL, "name"),
       _topic("framework", JOIN06_SQL, "framework", "version"),
       _topic("dependency", JOIN05_SQL, "name", "version || ' (' || status || ')'", "ord"),
       _topic("upgrade", f"SELECT * FROM ({V.V_OUTDATED_SQL}) WHERE current <> latest", "name", "current || ' -> ' || latest"),
       _topic("security", f"{_TOLD} AND title NOT IN ({_PERF})", "title", "description", "ord"),
       _topic("performance", f"{_TOLD} AND title IN ({_PERF})", "title", "description", "ord"),
       _topic("config_file", f"SELECT scan_id, name FROM ({V.V_NAMES_SQL}) WHERE kind = 'configFiles'", "name")]
    + [_topic(t, _STATS, t) for t in ("files_scanned", "files_ignored", "issues_found")]
    + [_topic("warning", f"SELECT scan_id, unnest(list_filter(string_split(warnings, chr(10)), lambda w: w <> '')) AS w FROM ({_STATS})", "w")])


def _quoted(v: str) -> str:
    return f"(CASE WHEN regexp_matches({v}, '[\",\\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END)"


def _lit(v) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


def lines_sql(layout: list[tuple], csv: bool) -> str:
    fixed = ", ".join(f"({i}, '{e[0]}', {_lit(e[1])}, " + ("NULL, NULL, NULL)" if e[0] == "text" else ", ".join(map(_lit, e[2:5])) + ")")
                      for i, e in enumerate(layout) if e[0] != "list")
    lists = ", ".join(f"({i}, {_lit(e[1])}, {_lit(e[2])}, {_lit(e[3])})" for i, e in enumerate(layout) if e[0] == "list")
    if csv:
        one = f"{_quoted('a')} || ',' || {_quoted('b')} || ',' || {_quoted('coalesce(v.value, d)')}"
        many = f"{_quoted('a')} || ',' || {_quoted('coalesce(b, name)')} || ',' || " + _quoted("coalesce(CASE WHEN b IS NOT NULL THEN name ELSE value END, '')")
    else:
        one = "CASE WHEN kind = 'text' THEN l.topic ELSE a || coalesce(v.value, d) || coalesce(b, '') END"
        many = "a || name || CASE WHEN b IS NOT NULL THEN b || coalesce(value, '') ELSE '' END"
    facts_sql = FACTS_SQL if csv else FACTS_SQL.replace("' -> '", "' → '")
    return f"""
WITH facts AS MATERIALIZED ({facts_sql}),
single AS (SELECT scan_id, topic, max(coalesce(value, name)) AS value FROM facts GROUP BY scan_id, topic)
SELECT s.scan_id, l.section_ord, CAST(0 AS BIGINT) AS ord, {one} AS line
FROM ({SCANS_SQL}) s CROSS JOIN (VALUES {fixed}) AS l(section_ord, kind, topic, a, b, d)
LEFT JOIN single v ON v.scan_id = s.scan_id AND v.topic = l.topic WHERE ({one}) IS NOT NULL
UNION ALL
SELECT f.scan_id, l.section_ord, f.ord, {many} AS line
FROM facts f JOIN (VALUES {lists}) AS l(section_ord, topic, a, b) ON l.topic = f.topic WHERE f.scan_id IN (SELECT scan_id FROM ({SCANS_SQL}))
"""


SNK02_SQL = lines_sql(K.BUNDLE_CSV, True)
SNK03_SQL = f"""
SELECT scan_id, 'Section,Key,Value' || chr(10) || string_agg(line, chr(10) ORDER BY section_ord, ord, line) AS csv
FROM ({lines_sql(K.COMBINED_CSV, True)}) GROUP BY scan_id
"""
SNK04_SQL = f"""
SELECT scan_id, string_agg(line, chr(10) ORDER BY section_ord, ord, line) AS markdown
FROM ({lines_sql(K.MARKDOWN, False)}) GROUP BY scan_id
"""


@register("SNK-02", SNK02_SQL)
def q_snk02(spark, sf_dir):
    return K.report_lines(scans(spark, sf_dir), facts(spark, sf_dir), K.BUNDLE_CSV, csv=True)


@register("SNK-03", SNK03_SQL)
def q_snk03(spark, sf_dir):
    lines = K.report_lines(scans(spark, sf_dir), facts(spark, sf_dir), K.COMBINED_CSV, csv=True)
    return K.report_text(lines, "Section,Key,Value", "csv")


@register("SNK-04", SNK04_SQL)
def q_snk04(spark, sf_dir):
    shown = facts(spark, sf_dir).withColumn("value", F.when(F.col("topic") == "upgrade", F.replace("value", F.lit(" -> "), F.lit(" → ")))
                                            .otherwise(F.col("value")))
    return K.report_text(K.report_lines(scans(spark, sf_dir), shown, K.MARKDOWN, csv=False), name="markdown")


def _listed(topic: str) -> str:
    return f"coalesce((SELECT list_sort(list(name)) FROM facts f WHERE f.scan_id = s.scan_id AND topic = '{topic}'), [])"


def _number(topic: str) -> str:
    return f"coalesce((SELECT max(CAST(name AS BIGINT)) FROM facts f WHERE f.scan_id = s.scan_id AND topic = '{topic}'), 0)"


def _kind(kind: str) -> str:
    return f"(SELECT count(*) FROM {FIND} f WHERE f.scan_id = s.scan_id AND kind = '{kind}')"


SNK01_SQL = f"""
WITH facts AS MATERIALIZED ({FACTS_SQL})
SELECT scan_id, '{{"id":"' || scan_id || '","repoUrl":"' || repo_url || '","repoDetails":' || to_json({{'repoName': 'org/' || scan_id}})
  || ',"projectFeatures":' || to_json({{'features': coalesce((SELECT list_sort(list(DISTINCT feature)) FROM ({V.V_FEATURES_SQL}) f
                                                             WHERE f.scan_id = s.scan_id AND feature IS NOT NULL), [])}})
  || ',"architecture":' || to_json({{'configFiles': {_listed('config_file')}}})
  || ',"compatibility":' || to_json({{'supportedFeatures': {_listed('supported_feature')}, 'partialFeatures': {_listed('partial_feature')},
       'unsupportedCode': {_listed('unsupported_item')}, 'missingConfigs': {_listed('missing_config')}, 'recommendations': {_listed('recommendation')}}})
  || ',"securityAndPerformance":' || to_json({{'vulnerabilities': {_kind('vulnerability')}, 'insecureApiCalls': {_kind('insecure_api')},
       'missingPolicies': {_kind('missing_policy')}}})
  || ',"healthAndMaintenance":{{}},"modernizationSuggestions":'
  || to_json(coalesce((SELECT list({{'ord': ord, 'title': title, 'severity': severity, 'category': category, 'file': file}} ORDER BY ord, title)
                       FROM ({V.V_SUGGESTIONS_SQL}) g WHERE g.scan_id = s.scan_id), []))
  || ',"analytics":' || to_json({{'supported': {_number('supported')}, 'partial': {_number('partial')}, 'unsupported': {_number('unsupported')},
       'suggested': {_number('suggested')}}})
  || ',"summaryLog":' || to_json({{'filesScanned': {_number('files_scanned')}, 'filesIgnored': {_number('files_ignored')},
       'issuesFound': {_number('issues_found')}, 'warnings': {_listed('warning')}}})
  || ',"generatedAt":"{GENERATED_AT}","apiVersion":"v1"}}' AS document
FROM ({SCANS_SQL}) s
"""


@register("SNK-01", SNK01_SQL)
def q_snk01(spark, sf_dir):
    all_scans = scans(spark, sf_dir)
    # one row per scan with a sorted list or a number per topic, in one aggregate
    names = lambda t: F.sort_array(F.collect_list(F.when(F.col("topic") == t, F.col("name"))))
    number = lambda t: F.coalesce(F.max(F.when(F.col("topic") == t, F.col("name").cast("long"))), F.lit(0).cast("long"))
    objects = {
        "architecture": {"configFiles": names("config_file")},
        "compatibility": {"supportedFeatures": names("supported_feature"), "partialFeatures": names("partial_feature"),
                          "unsupportedCode": names("unsupported_item"), "missingConfigs": names("missing_config"),
                          "recommendations": names("recommendation")},
        "analytics": {c: number(c) for c in ("supported", "partial", "unsupported", "suggested")},
        "summaryLog": {"filesScanned": number("files_scanned"), "filesIgnored": number("files_ignored"),
                       "issuesFound": number("issues_found"), "warnings": names("warning")}}
    shown = ["config_file", "supported_feature", "partial_feature", "unsupported_item", "missing_config", "recommendation", "supported",
             "partial", "unsupported", "suggested", "files_scanned", "files_ignored", "issues_found", "warning"]
    per = facts(spark, sf_dir).where(F.col("topic").isin(shown)).groupBy("scan_id").agg(
        *[F.struct(*[c.alias(k) for k, c in columns.items()]).alias(name) for name, columns in objects.items()])
    kinds = V.v_findings(spark, sf_dir).groupBy("scan_id").agg(*[
        F.sum((F.col("kind") == k).cast("int")).cast("long").alias(n)
        for n, k in (("vulnerabilities", S.VULN), ("insecureApiCalls", S.INSECURE), ("missingPolicies", S.POLICY))])
    feats = V.v_features(spark, sf_dir).filter(F.col("feature").isNotNull()).groupBy("scan_id").agg(
        F.sort_array(F.collect_set("feature")).alias("features"))
    parts = {
        "repoDetails": all_scans.select("scan_id", F.concat(F.lit("org/"), F.col("scan_id")).alias("repoName")),
        "projectFeatures": feats,
        "securityAndPerformance": kinds,
        "modernizationSuggestions": V.v_suggestions(spark, sf_dir).select("scan_id", "ord", "title", "severity", "category", "file"),
    }
    return K.report_json(all_scans.join(per, "scan_id", "left"), parts, GENERATED_AT)
