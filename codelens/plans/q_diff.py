"""Queries: scan diff (JOIN-07..11, 19, AGG-25), set operations, windows, routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codelens.operators import diff as D
from codelens.operators import score as S
from codelens.operators import window as W
from codelens.plans import bindings as V
from codelens.plans.catalog import register

A, B = "A", "R"
BASE = f"({V.V_BASELINE_SQL})"
SUGG = f"({V.V_SUGGESTIONS_SQL})"
FIND = f"({V.V_FINDINGS_SQL})"
NAMES = f"({V.V_NAMES_SQL})"

PAIR_SQL = f"""
SELECT file, feature,
       max(CASE WHEN scan_id = '{A}' THEN 1 ELSE 0 END) AS in_a,
       max(CASE WHEN scan_id = '{B}' THEN 1 ELSE 0 END) AS in_b,
       max(CASE WHEN scan_id = '{A}' THEN coalesce(status, 'unknown') END) AS status_a,
       max(CASE WHEN scan_id = '{B}' THEN coalesce(status, 'unknown') END) AS status_b
FROM {BASE} WHERE scan_id IN ('{A}', '{B}') GROUP BY file, feature
"""
JOIN07_SQL = f"""
SELECT file, feature, CASE WHEN in_b = 1 THEN 'added' ELSE 'removed' END AS change
FROM ({PAIR_SQL}) WHERE in_a <> in_b
"""


@register("JOIN-07", JOIN07_SQL)
def q_join07(spark, sf_dir):
    return D.diff_features(V.v_baseline(spark, sf_dir), A, B)


JOIN08_SQL = f"""
SELECT file, feature, status_a AS from_status, status_b AS to_status
FROM ({PAIR_SQL}) WHERE in_a = 1 AND in_b = 1 AND status_a <> status_b
"""


@register("JOIN-08", JOIN08_SQL)
def q_join08(spark, sf_dir):
    return D.diff_status(V.v_baseline(spark, sf_dir), A, B)


JOIN09_SQL = f"""
WITH s AS (SELECT *, coalesce(id, concat_ws(':', file, title)) AS key FROM {SUGG})
SELECT 'added' AS change, key, ord, title FROM s b
  WHERE scan_id = '{B}' AND key NOT IN (SELECT key FROM s WHERE scan_id = '{A}')
UNION ALL
SELECT 'removed', key, ord, title FROM s a
  WHERE scan_id = '{A}' AND key NOT IN (SELECT key FROM s WHERE scan_id = '{B}')
"""


@register("JOIN-09", JOIN09_SQL)
def q_join09(spark, sf_dir):
    return D.diff_suggestions(V.v_suggestions(spark, sf_dir), A, B).select("change", "key", "ord", "title")


JOIN10_SQL = f"""
SELECT kind, name, CASE WHEN in_b = 1 THEN 'added' ELSE 'removed' END AS change FROM (
  SELECT kind, name, max(CASE WHEN scan_id = '{A}' THEN 1 ELSE 0 END) AS in_a,
         max(CASE WHEN scan_id = '{B}' THEN 1 ELSE 0 END) AS in_b
  FROM {NAMES} WHERE scan_id IN ('{A}', '{B}') GROUP BY kind, name) WHERE in_a <> in_b
"""


@register("JOIN-10", JOIN10_SQL)
def q_join10(spark, sf_dir):
    return D.diff_names(V.v_names(spark, sf_dir), A, B)


def _delta(cond):
    return f"CAST(sum(CASE WHEN {cond} THEN (CASE WHEN scan_id = '{B}' THEN 1 ELSE -1 END) ELSE 0 END) AS BIGINT)"


LS = "lower(coalesce(status, 'unknown'))"
JOIN11_SQL = f"""
SELECT {_delta(f"{LS} = 'supported'")} AS supported, {_delta(f"{LS} = 'partial'")} AS partial,
       {_delta(f"{LS} = 'unsupported'")} AS unsupported,
       {_delta(f"{LS} NOT IN ('supported', 'partial', 'unsupported')")} AS unknown
FROM {BASE} WHERE scan_id IN ('{A}', '{B}')
"""


@register("JOIN-11", JOIN11_SQL)
def q_join11(spark, sf_dir):
    return D.diff_status_counts(V.v_baseline(spark, sf_dir), A, B)


JOIN19_SQL = f"""
WITH l AS (SELECT DISTINCT name FROM {NAMES} WHERE kind = 'frameworks' AND scan_id = '{A}'),
r AS (SELECT DISTINCT name FROM {NAMES} WHERE kind = 'frameworks' AND scan_id = '{B}')
SELECT coalesce(l.name, r.name) AS name,
       CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 'both' WHEN l.name IS NOT NULL THEN 'left' ELSE 'right' END AS side
FROM l FULL JOIN r ON l.name = r.name
"""


@register("JOIN-19", JOIN19_SQL)
def q_join19(spark, sf_dir):
    n = V.v_names(spark, sf_dir).filter(F.col("kind") == "frameworks")
    return D.compare_names(n.filter(F.col("scan_id") == A), n.filter(F.col("scan_id") == B))


AGG25_SQL = f"""
SELECT (SELECT count(DISTINCT file) FROM ({JOIN08_SQL})) AS files_changed,
       (SELECT CAST(count(*) AS BIGINT) FROM ({JOIN07_SQL}) WHERE change = 'added') AS features_added,
       (SELECT CAST(count(*) AS BIGINT) FROM ({JOIN07_SQL}) WHERE change = 'removed') AS features_removed,
       (SELECT CAST(count(*) AS BIGINT) FROM ({JOIN09_SQL}) WHERE change = 'added') AS suggestions_added,
       (SELECT CAST(count(*) AS BIGINT) FROM ({JOIN09_SQL}) WHERE change = 'removed') AS suggestions_removed
"""


@register("AGG-25", AGG25_SQL)
def q_agg25(spark, sf_dir):
    return D.diff_summary(V.v_baseline(spark, sf_dir), V.v_suggestions(spark, sf_dir), A, B)


# -- set operations -------------------------------------------------------------
SET01_SQL = f"""
SELECT scan_id, ord, kind, 'missingPolicies' AS tag FROM {FIND} WHERE kind = 'missing_policy'
UNION ALL SELECT scan_id, ord, kind, 'insecureApiCalls' FROM {FIND} WHERE kind = 'insecure_api'
"""


@register("SET-01", SET01_SQL)
def q_set01(spark, sf_dir):
    f = V.v_findings(spark, sf_dir).select("scan_id", "ord", "kind")
    return D.union_findings([f.filter(F.col("kind") == S.POLICY), f.filter(F.col("kind") == S.INSECURE)],
                            ["missingPolicies", "insecureApiCalls"])


SET02_SQL = f"""
SELECT scan_id, name FROM {NAMES} WHERE kind = 'frameworks'
UNION SELECT scan_id, name FROM {NAMES} WHERE kind = 'buildTools'
"""


@register("SET-02", SET02_SQL)
def q_set02(spark, sf_dir):
    n = V.v_names(spark, sf_dir)
    return D.union_names(n.filter(F.col("kind") == "frameworks").select("scan_id", "name"),
                         n.filter(F.col("kind") == "buildTools").select("scan_id", "name"))


SET03_SQL = f"""
SELECT kind, name FROM {NAMES} WHERE scan_id = '{A}'
EXCEPT SELECT kind, name FROM {NAMES} WHERE scan_id = '{B}'
"""


@register("SET-03", SET03_SQL)
def q_set03(spark, sf_dir):
    n = V.v_names(spark, sf_dir)
    return D.except_names(n.filter(F.col("scan_id") == A).select("kind", "name"),
                          n.filter(F.col("scan_id") == B).select("kind", "name"))


SET04_SQL = f"""
SELECT kind, name FROM {NAMES} WHERE scan_id = '{A}'
INTERSECT SELECT kind, name FROM {NAMES} WHERE scan_id = '{B}'
"""


@register("SET-04", SET04_SQL)
def q_set04(spark, sf_dir):
    n = V.v_names(spark, sf_dir)
    return D.common_names(n.filter(F.col("scan_id") == A).select("kind", "name"),
                          n.filter(F.col("scan_id") == B).select("kind", "name"))


SET05_SQL = f"""
SELECT scan_id, ord, kind, source FROM {FIND} WHERE kind = 'vulnerability'
UNION ALL SELECT scan_id, ord, 'vulnerability', 'semgrep' FROM {FIND} WHERE kind = 'ci'
"""


@register("SET-05", SET05_SQL)
def q_set05(spark, sf_dir):
    f = V.v_findings(spark, sf_dir)
    stored = f.filter(F.col("kind") == S.VULN).select("scan_id", "ord", "kind", "source")
    new = f.filter(F.col("kind") == S.CI).select("scan_id", "ord", F.lit(S.VULN).alias("kind"),
                                                 F.lit("semgrep").alias("source"))
    return D.append_findings(stored, new)


# -- routing scores and windows --------------------------------------------------
FILES = f"({V.V_FILES_SQL})"
DEPS = f"({V.V_DEPS_SQL})"
ROUTER_SQL = f"""
WITH f AS (SELECT * FROM ({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL}) WHERE ext IN ('.js', '.jsx', '.ts', '.tsx', '.md', '.py', '.java', '.go', '.ipynb')),
d AS (SELECT scan_id, name FROM {DEPS} UNION SELECT scan_id, name FROM ({V.V_PACKAGES_SQL})),
dr AS (
  SELECT DISTINCT scan_id, grp, name, w FROM (
    SELECT scan_id, 'frameworks' AS grp, 'Next.js' AS name, 3 AS w FROM d WHERE name = 'next'
    UNION ALL SELECT scan_id, 'frameworks', 'SvelteKit', 3 FROM d WHERE name = '@sveltejs/kit'
    UNION ALL SELECT scan_id, 'frameworks', 'Nuxt', 3 FROM d WHERE name = 'nuxt'
    UNION ALL SELECT scan_id, 'frameworks', 'Vue', 2 FROM d WHERE name = 'vue' OR starts_with(name, '@vue/')
    UNION ALL SELECT scan_id, 'frameworks', 'Angular', 3 FROM d WHERE name = '@angular/core'
    UNION ALL SELECT scan_id, 'frameworks', 'Express', 2 FROM d WHERE name = 'express'
    UNION ALL SELECT scan_id, 'frameworks', 'Nx', 2 FROM d WHERE name = 'nx' OR starts_with(name, '@nrwl/')
    UNION ALL SELECT scan_id, 'languages', 'TypeScript', 2 FROM d WHERE name = 'typescript')),
fr AS (
  SELECT scan_id, 'languages' AS grp, 'TypeScript' AS name, 1 AS w FROM f WHERE ext IN ('.ts', '.tsx')
  UNION ALL SELECT scan_id, 'languages', 'JavaScript', 1 FROM f WHERE ext IN ('.js', '.jsx', '.ts', '.tsx')
  UNION ALL SELECT scan_id, 'languages', 'Python', 2 FROM f WHERE ext IN ('.py', '.ipynb')
  UNION ALL SELECT scan_id, 'languages', 'Java', 2 FROM f WHERE ext = '.java'
  UNION ALL SELECT scan_id, 'languages', 'Go', 2 FROM f WHERE ext = '.go'
  UNION ALL SELECT scan_id, 'frameworks', 'Next.js', 1 FROM f WHERE contains(path, 'pages/') AND (ends_with(path, '.tsx') OR ends_with(path, '.jsx'))
  UNION ALL SELECT scan_id, 'frameworks', 'Nuxt', 2 FROM f WHERE ends_with(path, 'nuxt.config.ts') OR ends_with(path, 'nuxt.config.js')
  UNION ALL SELECT scan_id, 'frameworks', 'SvelteKit', 1 FROM f WHERE ends_with(path, 'svelte.config.js') OR contains(path, 'src/routes/')
  UNION ALL SELECT scan_id, 'frameworks', 'Angular', 2 FROM f WHERE ends_with(path, 'angular.json')
  UNION ALL SELECT scan_id, 'ml', 'TensorFlow', 3 FROM f WHERE ext = '.py' AND regexp_matches(lower(coalesce(content, '')), '(^|[^a-z0-9_])(import|from)\\s+tensorflow([^a-z0-9_]|$)')
  UNION ALL SELECT scan_id, 'ml', 'PyTorch', 3 FROM f WHERE ext = '.py' AND regexp_matches(lower(coalesce(content, '')), '(^|[^a-z0-9_])(import|from)\\s+torch([^a-z0-9_]|$)')
  UNION ALL SELECT scan_id, 'ml', 'Keras', 2 FROM f WHERE ext = '.py' AND regexp_matches(lower(coalesce(content, '')), '(^|[^a-z0-9_])(import|from)\\s+keras([^a-z0-9_]|$)')
  UNION ALL SELECT scan_id, 'ml', 'Scikit-learn', 2 FROM f WHERE ext = '.py' AND regexp_matches(lower(coalesce(content, '')), '(^|[^a-z0-9_])(import|from)\\s+sklearn([^a-z0-9_]|$)'))
SELECT scan_id, grp, name, CAST(sum(w) AS BIGINT) AS score FROM (SELECT * FROM dr UNION ALL SELECT * FROM fr)
GROUP BY scan_id, grp, name
"""


def router(spark, sf_dir):
    return W.router_scores(V.v_files(spark, sf_dir).unionByName(V.v_code(spark, sf_dir)),
                           V.v_deps(spark, sf_dir).unionByName(V.v_packages(spark, sf_dir)))


register("AGG-31", ROUTER_SQL)(router)

NAME_ORDER = " ".join(f"WHEN '{nm}' THEN {i}" for i, nm in enumerate(
    [nm for _, names in W.ROUTER_NAMES for nm in names]))
WIN01_SQL = f"""
SELECT scan_id, grp, name, score,
       row_number() OVER (PARTITION BY scan_id, grp ORDER BY score DESC, CASE name {NAME_ORDER} ELSE 99 END, name) AS rank
FROM ({ROUTER_SQL}) WHERE score > 0
"""


@register("WIN-01", WIN01_SQL)
def q_win01(spark, sf_dir):
    return W.rank_router(router(spark, sf_dir))


WIN02_SQL = f"""
WITH s AS (SELECT * FROM ({ROUTER_SQL}) WHERE score > 0),
m AS (SELECT scan_id, grp, max(score) AS mx FROM s GROUP BY scan_id, grp)
SELECT s.scan_id, s.grp, s.name, s.score, CAST(greatest(1, floor(m.mx * 0.5)) AS BIGINT) AS threshold,
       s.score >= greatest(1, floor(m.mx * 0.5)) AS allowed
FROM s JOIN m ON s.scan_id = m.scan_id AND s.grp = m.grp
"""


@register("WIN-02", WIN02_SQL)
def q_win02(spark, sf_dir):
    return W.allow_threshold(router(spark, sf_dir), 0.5)


# WIN-03: frameworks of each scan ordered by router rank (unranked ones last, by name).
WIN03_SQL = f"""
WITH fw AS ({V.V_FRAMEWORKS_SQL}),
rk AS (SELECT scan_id, name, rank FROM ({WIN01_SQL}) WHERE grp = 'frameworks')
SELECT fw.scan_id, fw.name,
       row_number() OVER (PARTITION BY fw.scan_id ORDER BY coalesce(rk.rank, 1073741824), fw.name) AS position
FROM fw LEFT JOIN rk ON fw.scan_id = rk.scan_id AND fw.name = rk.name
"""


@register("WIN-03", WIN03_SQL)
def q_win03(spark, sf_dir):
    return W.order_frameworks(V.v_frameworks(spark, sf_dir), W.rank_router(router(spark, sf_dir)))


WIN05_SQL = f"""
SELECT scan_id, file, ord, title FROM (
  SELECT scan_id, file, ord, title, row_number() OVER (PARTITION BY scan_id, file ORDER BY ord) AS rn
  FROM {FIND}) WHERE rn = 1
"""


@register("WIN-05", WIN05_SQL)
def q_win05(spark, sf_dir):
    f = V.v_findings(spark, sf_dir).select("scan_id", "file", "ord", "title")
    return W.first_match(f, ["scan_id", "file"], [F.col("ord")])


# WIN-06: retention with now = 1999-01-01, TTL 2 years, budget 20,000,000 per root.
NOW = dt.datetime(1999, 1, 1)
TTL = 2 * 365 * 86400
BUDGET = 20_000_000
WIN06_SQL = f"""
WITH e AS (SELECT *, epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(mtime) > {TTL} AS expired FROM ({V.V_CACHE_SQL})),
r AS (SELECT *, CASE WHEN NOT expired THEN CAST(sum(size) OVER (PARTITION BY root, expired ORDER BY mtime DESC, path
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS running_bytes FROM e)
SELECT root, path, size, mtime, running_bytes,
       CASE WHEN expired THEN 'expire' WHEN running_bytes > {BUDGET} THEN 'evict' ELSE 'keep' END AS action
FROM r
"""


@register("WIN-06", WIN06_SQL)
def q_win06(spark, sf_dir):
    return W.retention(V.v_cache(spark, sf_dir), NOW, TTL, BUDGET, by=["root"])
