"""Queries: detectors over the documents / pages corpora (DET-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import rules as _RULES
from codelens.operators import detect as D
from codelens.plans import bindings as V
from codelens.plans.catalog import register
from codelens.sources.manifests import read_go_requires

FILES = f"({V.V_FILES_SQL})"
PAGES = f"({V.V_PAGES_SQL})"
CORPUS = f"({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL})"


def corpus(spark, sf_dir):
    """Documents and the code corpus built from part: whole texts of both."""
    return V.v_files(spark, sf_dir).unionByName(V.v_code(spark, sf_dir))


@register("DET-01", None)
def q_det01(spark, sf_dir):
    """JS features over every .js file of the corpus (whole texts)."""
    return D.detect_js(corpus(spark, sf_dir))


@register("DET-02", None)
def q_det02(spark, sf_dir):
    return D.detect_css(corpus(spark, sf_dir))


@register("DET-03", None)
def q_det03(spark, sf_dir):
    f = D.detect_features(corpus(spark, sf_dir))
    return D.project_features(f).select("scan_id", F.array_join("features", ",").alias("features"))


# DET-17: insecure http:// references in each page's address and whole text.
DET17_SQL = f"""
SELECT scan_id, path AS file, 'insecure_api' AS kind, 'Insecure HTTP usage' AS title, 'High' AS severity,
       'Found http:// reference in ' || basename AS description
FROM {PAGES} WHERE regexp_matches(concat_ws(chr(10), url, content), '(?i)http://')
"""


@register("DET-17", DET17_SQL)
def q_det17(spark, sf_dir):
    pages = V.v_pages(spark, sf_dir).withColumn("content", F.concat_ws("\n", "url", "content"))
    return D.detect_security(pages, [".html"]).filter(F.col("title") == "Insecure HTTP usage")


@register("DET-18", None)
def q_det18(spark, sf_dir):
    """Full security rule array (DET-17..22) over page html and code files."""
    return D.detect_security(V.v_pages(spark, sf_dir).drop("url").unionByName(corpus(spark, sf_dir)))


@register("DET-23", None)
def q_det23(spark, sf_dir):
    f = corpus(spark, sf_dir)
    return D.sensitive_files(f, D.detect_security(f))


DET24_SQL = f"""
SELECT scan_id, path AS file, size, CAST(floor(size / 1024 + 0.5) AS BIGINT) AS kb, 'Large asset' AS title,
       'Low' AS severity, basename || ' — ' || CAST(CAST(floor(size / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' AS description
FROM {FILES} WHERE size > 10 * 1024
"""


@register("DET-24", DET24_SQL)
def q_det24(spark, sf_dir):
    return D.large_assets(V.v_files(spark, sf_dir), 10)


DET25_SQL = f"""
SELECT scan_id, 'Multiple large assets' AS title, 'Low' AS severity, CAST(count(*) AS VARCHAR) || ' assets exceed 10KB' AS description
FROM {FILES} WHERE size > 10 * 1024 GROUP BY scan_id HAVING count(*) > 3
"""


@register("DET-25", DET25_SQL)
def q_det25(spark, sf_dir):
    return D.bottlenecks(D.large_assets(V.v_files(spark, sf_dir), 10), 10)


@register("DET-26", None)
def q_det26(spark, sf_dir):
    return D.policy_gaps(corpus(spark, sf_dir).unionByName(V.v_pages(spark, sf_dir).drop("url")))


@register("DET-27", None)
def q_det27(spark, sf_dir):
    return D.ci_findings(corpus(spark, sf_dir))


@register("DET-14", None)
def q_det14(spark, sf_dir):
    return D.detect_configs(corpus(spark, sf_dir))


@register("DET-15", None)
def q_det15(spark, sf_dir):
    return D.build_tools(D.detect_configs(corpus(spark, sf_dir)))


@register("DET-16", None)
def q_det16(spark, sf_dir):
    return D.frameworks_from_configs(D.detect_configs(corpus(spark, sf_dir)))


@register("DET-04", None)
def q_det04(spark, sf_dir):
    f = corpus(spark, sf_dir)
    return D.detect_frameworks(f, read_go_requires(f))


DET30_SQL = f"""
SELECT DISTINCT feature,
  CASE WHEN starts_with(lower(feature), 'css-') OR starts_with(lower(feature), 'css.') THEN 'CSS'
       WHEN starts_with(lower(feature), 'aria-') OR starts_with(lower(feature), 'html-') OR starts_with(lower(feature), 'data-') THEN 'HTML'
       ELSE 'JS' END AS domain
FROM ({V.V_FEATURES_SQL})
"""


@register("DET-30", DET30_SQL)
def q_det30(spark, sf_dir):
    return V.v_features(spark, sf_dir).select("feature", D.feature_domain(F.col("feature")).alias("domain")).distinct()


REPO_RE = r"(?i)github\.com/(.*?)/(.*?)(?:\.git|$)"
URLS_SQL = f"""
SELECT id, repo_url AS url FROM ({V.V_SCANS_SQL})
UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), url FROM pages
"""
DET36_SQL = f"""
SELECT id, CASE WHEN contains(url, 'github.com') THEN 'github' ELSE 'unknown' END AS provider,
       CASE WHEN regexp_matches(url, '{REPO_RE}') THEN regexp_extract(url, '{REPO_RE}', 1) END AS owner,
       CASE WHEN regexp_matches(url, '{REPO_RE}') THEN regexp_extract(url, '{REPO_RE}', 2) END AS repo
FROM ({URLS_SQL})
"""


@register("DET-36", DET36_SQL)
def q_det36(spark, sf_dir):
    """Provider / owner / repo of every scan's repository URL and every page URL."""
    s = V.v_scans(spark, sf_dir).select("id", F.col("repo_url").alias("url"))
    p = V.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")
    r = D.repo_identity(F.col("url"))
    return s.unionByName(p).select("id", r["provider"].alias("provider"), r["owner"].alias("owner"), r["repo"].alias("repo"))


DET37_SQL = f"""
SELECT scan_id, name AS package, current AS from_version, latest AS to_version
FROM ({V.V_OUTDATED_SQL}) WHERE latest IS NOT NULL AND coalesce(current, '') <> latest
"""


@register("DET-37", DET37_SQL)
def q_det37(spark, sf_dir):
    return D.upgrades(V.v_outdated(spark, sf_dir))


API_CASE = " ".join(f"WHEN regexp_matches(name, '(?i){pat}') THEN '{t}'" for pat, t in D.API_LAYER_RULES)
TEST_UNION = " UNION ALL ".join(
    f"SELECT scan_id, 'testing' AS category, '{t}' AS name FROM d WHERE regexp_matches(name, '(?i){pat}')"
    for pat, t in D.TEST_DEP_RULES)
CONFIG_UNION = " UNION ALL ".join(
    f"SELECT scan_id, '{kind}' AS category, '{t}' AS name FROM cf WHERE regexp_matches(name, '(?i){pat}')"
    for kind, table_ in (("testing", D.TEST_CONFIG_RULES), ("cicd", D.CICD_RULES)) for pat, t in table_)
DET31_SQL = f"""
WITH d AS (SELECT DISTINCT scan_id, name FROM (SELECT scan_id, name FROM ({V.V_DEPS_SQL}) UNION ALL SELECT scan_id, name FROM ({V.V_PACKAGES_SQL}))),
cf AS ({V.V_CONFIGS_SQL}),
fw AS ({V.V_FRAMEWORKS_SQL})
SELECT DISTINCT * FROM (
  SELECT scan_id, 'ui' AS category, name FROM fw WHERE regexp_matches(name, '{D.UI_FRAMEWORK_PATTERN}')
  UNION ALL {TEST_UNION}
  UNION ALL {CONFIG_UNION}
  UNION ALL SELECT scan_id, 'api', CASE {API_CASE} END FROM d WHERE (CASE {API_CASE} END) IS NOT NULL)
"""


@register("DET-31", DET31_SQL)
def q_det31(spark, sf_dir):
    deps = V.v_deps(spark, sf_dir).unionByName(V.v_packages(spark, sf_dir))
    return D.tech_classes(deps, V.v_frameworks(spark, sf_dir), V.v_configs(spark, sf_dir))


# Sub-rules of the framework detector (DET-05..13) and of the security rule
# array (DET-19..22) and CI scan (DET-28): the same one-pass operator, with the
# output restricted to the rule's own findings.
FRAMEWORK_GROUPS = {
    "DET-05": ["Angular"],
    "DET-06": ["Flask", "FastAPI", "Django", "Spring Boot", "Hibernate", "JPA"],
    "DET-07": ["Go (Gin)", "Go (Echo)", "Go (Fiber)", "Go (Chi)", "Go (Gorilla Mux)", "GORM"],
    "DET-08": ["Next.js"],
    "DET-09": ["SvelteKit", "Svelte"],
    "DET-10": ["Nuxt"],
    "DET-11": ["Vue"],
    "DET-12": ["Nx"],
    "DET-13": ["TensorFlow", "PyTorch", "Keras", "Scikit-learn", "Jupyter Notebook", "ML Artifacts"],
}
SECURITY_GROUPS = {
    "DET-19": ["Blocking I/O", "Dynamic code execution"],
    "DET-20": ["Potential XSS risk"],
    "DET-21": ["Cookie without httpOnly", "Cookie without secure", "Session cookie flags"],
    "DET-22": ["Sensitive file"],
}


def _framework_query(names):
    def q(spark, sf_dir):
        f = corpus(spark, sf_dir).unionByName(V.v_pages(spark, sf_dir).drop("url"))
        return D.detect_frameworks(f, read_go_requires(f)).filter(F.col("name").isin(*names))
    return q


def _security_query(titles):
    def q(spark, sf_dir):
        f = corpus(spark, sf_dir).unionByName(V.v_pages(spark, sf_dir).drop("url"))
        return D.detect_security(f).filter(F.col("title").isin(*titles))
    return q


for _id, _names in FRAMEWORK_GROUPS.items():
    register(_id, None)(_framework_query(_names))
for _id, _titles in SECURITY_GROUPS.items():
    register(_id, None)(_security_query(_titles))


@register("DET-28", None)
def q_det28(spark, sf_dir):
    return D.ci_findings(corpus(spark, sf_dir)).filter(F.col("title") == "Unpinned action version")


DET29_SQL = f"""
WITH fe AS (SELECT scan_id, bool_or(lower(feature) = 'terraform') AS has_terraform,
                   bool_or(lower(feature) IN ('k8s', 'kubernetes', 'helm')) AS has_k8s,
                   bool_or(lower(feature) IN ('docker', 'container')) AS has_docker
            FROM ({V.V_FEATURES_SQL}) GROUP BY scan_id),
cf AS (SELECT scan_id, list_sort(list(DISTINCT basename))[1:200] AS files FROM {CORPUS}
       WHERE basename IN ({', '.join(repr(n) for n in _RULES.CONFIG_FILE_NAMES)})
       GROUP BY scan_id)
SELECT coalesce(fe.scan_id, cf.scan_id) AS scan_id, coalesce(has_terraform, false) AS has_terraform,
       coalesce(has_k8s, false) AS has_k8s, coalesce(has_docker, false) AS has_docker,
       array_to_string(coalesce(files, []), ',') AS files
FROM fe FULL JOIN cf ON fe.scan_id = cf.scan_id
"""


@register("DET-29", DET29_SQL)
def q_det29(spark, sf_dir):
    """IaC flags over the project-feature table and the config files of the
    corpora (per scan; scans present in either input)."""
    iac = D.iac_checks(V.v_features(spark, sf_dir).select("scan_id", "feature"), D.detect_configs(corpus(spark, sf_dir)))
    return iac.select("scan_id", "has_terraform", "has_k8s", "has_docker", F.array_join("files", ",").alias("files"))


# -- oracles for the detectors whose rules RE2 can express ----------------------
from codelens import rules as _R  # noqa: E402
from codelens.plans.catalog import ORACLE  # noqa: E402

SEC_EXTS = "('.js', '.jsx', '.ts', '.tsx', '.html')"
_C = "coalesce(content, '')"
_COOKIE = f"regexp_matches({_C}, '(?i)res\\.cookie\\s*\\(')"
_SESSION = f"""regexp_matches({_C}, '(?i)require\\([''"]express-session[''"]\\)|from\\s+[''"]express-session[''"]')"""
SEC_RULES_SQL = [
    (f"regexp_matches({_C}, '(?i)http://')", "insecure_api", "Insecure HTTP usage", "High", "Found http:// reference in"),
    (f"""regexp_matches({_C}, '(?i)app\\.use\\(\\s*cors\\s*\\(\\s*\\)\\s*\\)') OR regexp_matches({_C}, '(?i)origin\\s*:\\s*[''"][*][''"]')""",
     "missing_policy", "Permissive CORS", "Medium", "Wildcard CORS policy in"),
    (f"""regexp_matches({_C}, '(?i)cors\\s*\\(\\s*\\{{[^}}]*origin\\s*:\\s*[''"][*][''"][^}}]*credentials\\s*:\\s*true')""",
     "missing_policy", "Permissive CORS with credentials", "High", "Wildcard origin and credentials=true in"),
    (f"""regexp_matches({_C}, '(?i)cors\\s*\\(\\s*\\{{[^}}]*(allowedHeaders|methods)\\s*:\\s*[''"][*][''"]')""",
     "missing_policy", "Wildcard CORS headers/methods", "Medium", "Wildcard headers or methods in"),
    (f"regexp_matches({_C}, 'fs\\.[a-zA-Z]+Sync\\(') OR contains({_C}, 'execSync(') OR contains({_C}, 'spawnSync(')",
     "inefficient", "Blocking I/O", "Medium", "Synchronous operation in"),
    (f"regexp_matches({_C}, 'eval\\s*\\(') OR regexp_matches({_C}, 'new\\s+Function\\s*\\(')",
     "inefficient", "Dynamic code execution", "High", "Use of eval/new Function in"),
    (f"regexp_matches({_C}, 'document\\.write\\s*\\(') OR regexp_matches({_C}, 'dangerouslySetInnerHTML\\s*:\\s*') "
     f"OR regexp_matches({_C}, 'innerHTML\\s*=')", "insecure_api", "Potential XSS risk", "Medium", "Direct HTML injection pattern in"),
    (f"{_COOKIE} AND NOT regexp_matches({_C}, '(?i)httpOnly\\s*:\\s*true')", "insecure_api", "Cookie without httpOnly",
     "Medium", "res.cookie missing httpOnly in"),
    (f"{_COOKIE} AND NOT regexp_matches({_C}, '(?i)secure\\s*:\\s*true')", "insecure_api", "Cookie without secure",
     "Low", "res.cookie missing secure in"),
    (f"{_SESSION} AND NOT (regexp_matches({_C}, '(?i)cookie\\s*:\\s*\\{{[^}}]*secure\\s*:\\s*true') AND "
     f"regexp_matches({_C}, '(?i)cookie\\s*:\\s*\\{{[^}}]*httpOnly\\s*:\\s*true'))", "missing_policy", "Session cookie flags",
     "Medium", "express-session cookies missing secure/httpOnly in"),
    (f"regexp_matches({_C}, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches({_C}, '-----BEGIN\\s+PRIVATE\\s+KEY-----')",
     "sensitive", "Sensitive file", "High", "Secret pattern in"),
]
SEC_SOURCE = (f"(SELECT scan_id, path, basename, ext, content FROM {CORPUS} UNION ALL "
              f"SELECT scan_id, path, basename, ext, content FROM {PAGES})")


def security_sql(src: str, titles: list[str] | None = None) -> str:
    parts = []
    for cond, kind, title, sev, desc in SEC_RULES_SQL:
        if titles is not None and title not in titles:
            continue
        parts.append(f"SELECT scan_id, path AS file, '{kind}' AS kind, '{title}' AS title, '{sev}' AS severity, "
                     f"'{desc} ' || basename AS description FROM {src} WHERE ext IN {SEC_EXTS} AND ({cond})")
    return "\nUNION ALL\n".join(parts)


ORACLE["DET-18"] = security_sql(SEC_SOURCE)
for _id, _titles in SECURITY_GROUPS.items():
    ORACLE[_id] = security_sql(SEC_SOURCE, _titles)

ORACLE["DET-14"] = (f"SELECT DISTINCT scan_id, basename AS name FROM {CORPUS} WHERE basename IN "
                    f"({', '.join(repr(n) for n in _R.CONFIG_FILE_NAMES)})")
ORACLE["DET-15"] = (f"SELECT DISTINCT c.scan_id, t.tool AS name FROM ({ORACLE['DET-14']}) c JOIN (VALUES "
                    f"{', '.join(f'({c!r}, {t!r})' for c, t in _R.BUILD_TOOL_RULES)}) AS t(config, tool) ON c.name = t.config")
ORACLE["DET-16"] = (f"SELECT DISTINCT c.scan_id, t.fw AS name FROM ({ORACLE['DET-14']}) c JOIN (VALUES "
                    f"{', '.join(f'({c!r}, {t!r})' for c, t in _R.CONFIG_FRAMEWORK_RULES)}) AS t(config, fw) ON c.name = t.config")
ORACLE["DET-23"] = f"""
SELECT DISTINCT scan_id, name FROM (
  SELECT scan_id, basename AS name FROM {CORPUS}
  WHERE contains(basename, '.npmrc') OR contains(basename, '.yarnrc') OR contains(basename, 'credentials') OR contains(basename, '.env')
  UNION ALL
  SELECT scan_id, regexp_extract(file, '[^/]*$', 0) AS name FROM ({security_sql(CORPUS, ['Sensitive file'])}))
"""

_WF = (f"(SELECT scan_id, basename AS file, coalesce(content, '') AS c FROM {CORPUS} "
       f"WHERE regexp_matches(path, '(^|/)\\.github/workflows/') AND ext IN ('.yml', '.yaml'))")
_UNPINNED = f"""
SELECT scan_id, file, 'Unpinned action version' AS title, 'Medium' AS severity,
       'Action ' || a || '@' || v || ' not pinned to commit SHA.' AS description
FROM (SELECT scan_id, file, unnest(regexp_extract_all(c, '(?i)uses\\s*:\\s*([^\\s]+)@([^\\s]+)', 1)) AS a,
             unnest(regexp_extract_all(c, '(?i)uses\\s*:\\s*([^\\s]+)@([^\\s]+)', 2)) AS v FROM {_WF})
WHERE NOT regexp_matches(v, '(?i)^[0-9a-f]{{7,40}}$')
"""
ORACLE["DET-28"] = _UNPINNED
ORACLE["DET-27"] = f"""
SELECT scan_id, file, 'Workflow triggered by pull_request_target' AS title, 'High' AS severity,
       'pull_request_target runs with elevated permissions; prefer pull_request with least privileges.' AS description
FROM {_WF} WHERE regexp_matches(lower(c), '(^|[^a-z0-9_])on\\s*:\\s*[\\s\\S]*pull_request_target([^a-z0-9_]|$)')
UNION ALL
SELECT scan_id, file, 'Missing explicit permissions for GITHUB_TOKEN', 'Medium',
       'Define permissions: at workflow/job level to enforce least privilege.'
FROM {_WF} WHERE NOT regexp_matches(c, '(?i)\\n\\s*permissions\\s*:')
UNION ALL
SELECT scan_id, file, 'Self-hosted runner used', 'Medium', 'Ensure self-hosted runners are trusted and hardened.'
FROM {_WF} WHERE regexp_matches(c, '(?i)runs-on\\s*:\\s*self-hosted')
UNION ALL
SELECT scan_id, file, 'Checkout persists credentials', 'Medium', 'Set with: persist-credentials: false to avoid leaking GITHUB_TOKEN.'
FROM {_WF} WHERE regexp_matches(c, '(?i)uses\\s*:\\s*actions/checkout@') AND NOT regexp_matches(c, '(?i)persist-credentials\\s*:\\s*false')
UNION ALL
{_UNPINNED}
"""


def _sig(pattern: str) -> str:
    return f"bool_or(regexp_matches(coalesce(content, ''), '{pattern}'))"


_SIG = {k: _sig(p.replace("'", "''")) for k, (_lits, p) in D.POLICY_SIGNALS.items()}
_NOH = "(NOT helmet_import OR NOT helmet_use)"
ORACLE["DET-26"] = f"""
WITH s AS (SELECT scan_id, {', '.join(f'{v} AS {k}' for k, v in _SIG.items())}
           FROM (SELECT scan_id, ext, content FROM {CORPUS} UNION ALL SELECT scan_id, ext, content FROM {PAGES})
           WHERE ext IN {SEC_EXTS} GROUP BY scan_id),
e AS (SELECT * FROM s WHERE express)
SELECT scan_id, 'CSP' AS title, CASE WHEN {_NOH} THEN 'Content Security Policy not configured (helmet)'
       ELSE 'Content Security Policy not configured' END AS description, 'High' AS severity FROM e WHERE {_NOH} OR NOT csp
UNION ALL SELECT scan_id, 'HSTS', 'Strict-Transport-Security not enforced', 'High' FROM e WHERE {_NOH} OR NOT hsts
UNION ALL SELECT scan_id, 'X-Frame-Options', 'Frameguard missing (clickjacking protection)', 'Medium' FROM e WHERE {_NOH} OR NOT frameguard
UNION ALL SELECT scan_id, 'X-Content-Type-Options', 'MIME sniffing protection missing (noSniff)', 'Medium' FROM e WHERE {_NOH} OR NOT nosniff
UNION ALL SELECT scan_id, 'Referrer-Policy', 'Referrer policy not set', 'Low' FROM e WHERE {_NOH} OR NOT referrer
UNION ALL SELECT scan_id, 'Permissions-Policy', 'Permissions policy not set', 'Low' FROM e WHERE {_NOH} OR NOT permissions
UNION ALL SELECT scan_id, 'X-Powered-By', 'X-Powered-By header not disabled', 'Low' FROM e WHERE NOT no_xpb
UNION ALL SELECT scan_id, 'CSRF', 'CSRF protection not configured', 'High' FROM e WHERE NOT csurf_import OR NOT csurf_use
UNION ALL SELECT scan_id, 'Rate limiting', 'Express rate limiting not configured', 'Medium' FROM e WHERE NOT ratelimit_import OR NOT ratelimit_use
"""


# -- oracle for framework detection (DET-04..13) -------------------------------
def _word(w: str) -> str:
    return f"(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)"


def _has(lst: str, name: str) -> str:
    return f"coalesce(list_contains({lst}, '{name}'), false)"


def framework_sql(src: str) -> str:
    js = "('.js', '.jsx', '.ts', '.tsx')"
    pym = D.PY_JAVA_MANIFESTS
    sig = {
        "react": f"root_pkg AND ({_has('dk', 'react')} OR {_has('vk', 'react')})",
        "angular_dep": f"root_pkg AND ({_has('dk', 'angular')} OR {_has('vk', 'angular')})",
        "vue_dep": f"root_pkg AND ({_has('dk', 'vue')} OR {_has('vk', 'vue')})",
        "express_dep": f"root_pkg AND {_has('dk', 'express')}",
        "next_dep": f"root_pkg AND {_has('dk', 'next')}",
        "angular_any": f"is_pkg AND (regexp_matches(scripts, '{_word('ng')}') OR {_has('dk', '@angular/core')} OR {_has('vk', '@angular/core')})",
        "angular_json": "b = 'angular.json'",
        "flask": f"regexp_matches(p, '{pym}') AND contains(low, 'flask')",
        "fastapi": f"regexp_matches(p, '{pym}') AND contains(low, 'fastapi')",
        "django": f"regexp_matches(p, '{pym}') AND contains(low, 'django')",
        "spring": f"regexp_matches(p, '{pym}') AND regexp_matches(low, 'spring-boot|springframework')",
        "hibernate": f"regexp_matches(p, '{pym}') AND contains(low, 'hibernate')",
        "jpa": f"regexp_matches(p, '{pym}') AND regexp_matches(low, 'jakarta\\.persistence|javax\\.persistence')",
        "next": f"p IN ('next.config.js', 'next.config.mjs') OR (root_pkg AND ({_has('names', 'next')} OR regexp_matches(scripts, '{_word('next')}')))"
                f" OR starts_with(p, 'pages/') OR starts_with(p, 'app/')"
                f" OR (e IN {js} AND regexp_matches(c, 'from\\s+[''\"]next/(link|router|head)[''\"]'))",
        "sveltekit": f"(root_pkg AND {_has('names', '@sveltejs/kit')}) OR starts_with(p, 'src/routes/')",
        "svelte": f"p IN ('svelte.config.js', 'svelte.config.mjs') OR (root_pkg AND {_has('names', 'svelte')}) OR e = '.svelte'",
        "nuxt": f"p IN ('nuxt.config.js', 'nuxt.config.ts', 'nuxt.config.mjs', 'nuxt.config.cjs')"
                f" OR (root_pkg AND ({_has('names', 'nuxt')} OR regexp_matches(scripts, '{_word('(nuxt|nuxi)')}')))"
                f" OR starts_with(p, 'pages/') OR starts_with(p, 'src/pages/') OR p = 'app.vue' OR starts_with(p, 'server/')",
        "vue": f"p IN ('vue.config.js', 'vue.config.ts', 'vue.config.mjs', 'vue.config.cjs')"
               f" OR (root_pkg AND ({_has('names', 'vue')} OR {_has('names', '@vue/cli-service')} OR regexp_matches(scripts, '{_word('vue-cli-service')}')))"
               f" OR (p IN ('src/main.js', 'src/main.ts') AND regexp_matches(c, 'from\\s+[''\"]vue[''\"]'))"
               f" OR (starts_with(p, 'src/') AND e = '.vue')",
        "nx": "p IN ('nx.json', 'workspace.json') OR (root_pkg AND coalesce(list_bool_or(list_transform(names, lambda n: n = 'nx' OR starts_with(n, '@nrwl/'))), false))"
              " OR (CASE WHEN b = 'project.json' AND json_valid(c) THEN (json_extract(c, '$.projectType') IS NOT NULL"
              " OR json_extract(c, '$.sourceRoot') IS NOT NULL OR json_extract(c, '$.targets') IS NOT NULL) ELSE false END)",
        "notebook": "e = '.ipynb'",
        "ml_artifacts": f"e IN ({', '.join(repr(x) for x in D.ML_ARTIFACT_EXTS)})",
    }
    for mod, key in [("tensorflow", "tensorflow"), ("torch", "pytorch"), ("keras", "keras"), ("sklearn", "sklearn")]:
        sig[key] = (f"e = '.py' AND contains(low, '{mod}') AND "
                    f"regexp_matches(low, '(^|[^a-z0-9_])(import|from)\\s+{mod}([^a-z0-9_]|$)')")
    names = dict(D.FRAMEWORK_RULES)
    union = "\nUNION ALL ".join(f"SELECT scan_id, '{names[k]}' AS name FROM s WHERE {k}" for k, _ in D.FRAMEWORK_RULES)
    go = "\nUNION ALL ".join(
        f"SELECT scan_id, '{nm}' FROM gr WHERE regexp_matches(module, '{pat}')" for pat, nm in D.GO_FRAMEWORKS)
    go_sql = go_requires_sql(src)
    return f"""
WITH f AS (SELECT scan_id, path AS p, basename AS b, ext AS e, coalesce(content, '') AS c FROM {src}),
x AS (SELECT *, lower(c) AS low, b = 'package.json' AND NOT contains(p, 'node_modules') AS is_pkg0,
             p = 'package.json' AS root_pkg0 FROM f),
y AS (SELECT *, is_pkg0 AND json_valid(c) AS is_pkg, root_pkg0 AND json_valid(c) AS root_pkg,
             CASE WHEN is_pkg0 AND json_valid(c) THEN coalesce(json_keys(json_extract(c, '$.dependencies')), []) END AS dk,
             CASE WHEN is_pkg0 AND json_valid(c) THEN coalesce(json_keys(json_extract(c, '$.devDependencies')), []) END AS vk,
             CASE WHEN is_pkg0 AND json_valid(c) THEN coalesce(array_to_string(map_values(json_transform(
                  json_extract(c, '$.scripts'), '"MAP(VARCHAR, VARCHAR)"')), ' '), '') ELSE '' END AS scripts
      FROM x),
z AS (SELECT *, list_concat(coalesce(dk, []), coalesce(vk, [])) AS names FROM y),
s AS (SELECT scan_id, {', '.join(f'coalesce(bool_or({v}), false) AS {k}' for k, v in sig.items())} FROM z GROUP BY scan_id),
gr AS ({go_sql})
SELECT DISTINCT scan_id, name FROM (
  {union}
  UNION ALL SELECT scan_id, 'SvelteKit' FROM s WHERE sveltekit
  UNION ALL SELECT scan_id, 'Svelte' FROM s WHERE NOT sveltekit AND svelte
  UNION ALL {go})
"""


def go_requires_sql(src: str) -> str:
    """go.mod requires (the SRC-16 oracle) over any corpus view."""
    from codelens.plans.q_sources import SRC16_SQL
    return SRC16_SQL.replace(f"({V.V_CODE_SQL})", src)


_CORPUS_PAGES = f"({V.V_FILES_SQL} UNION ALL {V.V_CODE_SQL} UNION ALL SELECT scan_id, path, dir, basename, ext, size, content, ord FROM {PAGES})"
ORACLE["DET-04"] = framework_sql(CORPUS)
for _id, _names in FRAMEWORK_GROUPS.items():
    _in = ", ".join(f"'{n}'" for n in _names)
    ORACLE[_id] = f"SELECT scan_id, name FROM ({framework_sql(_CORPUS_PAGES)}) WHERE name IN ({_in})"


# DET-02 oracle: CSS declarations are the segments between '{' or ';' and the
# next ';' or '}' that read "prop: value" (split on the delimiters instead of
# a lookahead).
# Comments, strings and unquoted addresses go first; SCSS has line comments besides.
_CSS_LITERAL_RE2 = (r"""/\*(?s:.*?)\*/|"([^"\\\n]|\\(?s:.))*"|''([^''\\\n]|\\(?s:.))*''|(?i:url)\(\s*[^"''()\s][^()\n]*\)""")
DET02_SQL = f"""
WITH f AS (SELECT scan_id, path, CASE WHEN ext = '.scss' THEN regexp_replace(coalesce(content, ''), '{_CSS_LITERAL_RE2}|//[^\\n]*', ' ', 'g')
                  ELSE regexp_replace(coalesce(content, ''), '{_CSS_LITERAL_RE2}', ' ', 'g') END AS css
           FROM {CORPUS} WHERE ext IN ('.css', '.scss')),
g AS (SELECT scan_id, path, css, regexp_extract_all(css, '([^{{}};]*)([{{}};]|$)', 1) AS s,
             regexp_extract_all(css, '([^{{}};]*)([{{}};]|$)', 2) AS d FROM f),
dl AS (SELECT scan_id, path, css, list_filter(list_transform(range(2, len(s) + 1), lambda i:
         CASE WHEN d[i - 1] IN ('{{', ';', '}}') AND d[i] IN (';', '}}')
                   AND regexp_matches(s[i], '(?s)^\\s*(-?-?[A-Za-z][\\w-]*)\\s*:\\s*(.*)$')
              THEN {{'p': trim(regexp_extract(s[i], '(?s)^\\s*(-?-?[A-Za-z][\\w-]*)\\s*:', 1)),
                    'v': regexp_extract(s[i], '(?s)^\\s*-?-?[A-Za-z][\\w-]*\\s*:\\s*(.*)$', 1)}} END),
         lambda x: x IS NOT NULL) AS decls FROM g),
nb AS (SELECT scan_id, path, regexp_extract_all(css, '([^{{}}]*)([{{}}]|$)', 1) AS s, regexp_extract_all(css, '([^{{}}]*)([{{}}]|$)', 2) AS d
       FROM f WHERE contains(css, '&')),
nd AS (SELECT *, list_transform(range(1, len(d) + 1), lambda i:
         len(list_filter(d[1:i - 1], lambda x: x = '{{')) - len(list_filter(d[1:i - 1], lambda x: x = '}}'))) AS depth,
         list_transform(s, lambda x: trim(regexp_extract(x, '[^;]*$', 0), E' \n\t\r')) AS sel FROM nb),
nest AS (SELECT scan_id, path, list_bool_or(list_transform(range(1, len(d) + 1), lambda i:
           d[i] = '{{' AND contains(sel[i], '&') AND NOT starts_with(sel[i], '@')
           AND coalesce(NOT starts_with(sel[list_max(list_filter(range(1, i), lambda j: d[j] = '{{' AND depth[j] = depth[i] - 1))], '@'), false))) AS hit FROM nd),
r AS (SELECT scan_id, path,
        contains(css, ':has(') AS has_pseudo,
        list_bool_or(list_transform(decls, lambda x: starts_with(x.p, '--'))) AS variables,
        list_bool_or(list_transform(decls, lambda x: x.p = 'backdrop-filter')) AS backdrop,
        list_bool_or(list_transform(decls, lambda x: contains(x.p, 'grid'))) AS grid,
        list_bool_or(list_transform(decls, lambda x: x.p IN ('grid-template-columns', 'grid-template-rows')
                                                   AND contains(x.v, 'subgrid'))) AS subgrid,
        list_bool_or(list_transform(decls, lambda x: contains(x.p, 'flex'))) AS flexbox,
        list_bool_or(list_transform(decls, lambda x: contains(x.v, 'clamp('))) AS clamp,
        contains(css, '@container') AND regexp_matches(css, '@container([^A-Za-z0-9_-]|$)') AS container
      FROM dl)
SELECT scan_id, path AS file, 'css-has-pseudo' AS feature FROM r WHERE has_pseudo
UNION ALL SELECT scan_id, path, 'css-nesting' FROM nest WHERE hit
UNION ALL SELECT scan_id, path, 'css-variables' FROM r WHERE variables
UNION ALL SELECT scan_id, path, 'css-backdrop-filter' FROM r WHERE backdrop
UNION ALL SELECT scan_id, path, 'css-grid' FROM r WHERE grid
UNION ALL SELECT scan_id, path, 'css-subgrid' FROM r WHERE subgrid
UNION ALL SELECT scan_id, path, 'css-flexbox' FROM r WHERE flexbox
UNION ALL SELECT scan_id, path, 'css-clamp' FROM r WHERE clamp
UNION ALL SELECT scan_id, path, 'css-container-queries' FROM r WHERE container
"""
ORACLE["DET-02"] = DET02_SQL


# DET-01 oracle: the JS rules in RE2 form.  Lookarounds are rewritten into
# equivalent plain patterns; top-level await splits on the literal 'await',
# keeps the occurrences whose neighbours are not identifier characters, and
# takes brace prefix sums over the segments.
def _sqlq(p: str) -> str:
    return p.replace("'", "''")


_JS_RE2 = {k: p for k, _lit, p in D.JS_RULES}
_JS_RE2["nullish-coalescing"] = r"\?\?([^=]|$)"
# literals and comments as RE2 reads them (no possessive loops needed there)
_STRIP_RE2 = (r"""//[^\n]*|/\*(?s:.*?)\*/|"([^"\\\n]|\\(?s:.))*"|'([^'\\\n]|\\(?s:.))*'|`([^`\\]|\\(?s:.))*`""")
# a class field: statement start, modifiers, name, optional type, then "=" (no "==", "=>") or ";"
_FIELD_RE2 = (r"(^|[;\n])\s*((public|private|protected|readonly|static|declare|override)\s+)*[A-Za-z_$][A-Za-z0-9_$]*[?!]?\s*(:[^;=(){}]+)?")
_BAL = "(length(x) - length(replace(x, '{', ''))) - (length(x) - length(replace(x, '}', '')))"
DET01_SQL = f"""
WITH f AS (SELECT scan_id, path, coalesce(content, '') AS raw,
                  regexp_replace(coalesce(content, ''), '{_sqlq(_STRIP_RE2)}', ' ', 'g') AS c
           FROM {CORPUS} WHERE ext IN ('.js', '.jsx', '.ts', '.tsx')),
t AS (SELECT *, string_split(c, 'await') AS segs FROM f),
t2 AS (SELECT *, list_transform(segs, lambda x: {_BAL}) AS bal FROM t),
tla AS (SELECT scan_id, path, coalesce(list_bool_or(list_transform(range(1, len(segs)), lambda j:
          NOT regexp_matches(segs[j], '[A-Za-z0-9_$.]$') AND NOT regexp_matches(segs[j + 1], '^[A-Za-z0-9_$]')
          AND list_sum(bal[1:j]) <= 0)), false) AS hit FROM t2),
-- segments between braces; a segment belongs to the nearest open brace one level up
cb AS (SELECT scan_id, path, regexp_extract_all(c, '([^{{}}]*)([{{}}]|$)', 1) AS s, regexp_extract_all(c, '([^{{}}]*)([{{}}]|$)', 2) AS d
       FROM f WHERE contains(c, 'class')),
cd AS (SELECT *, list_transform(range(1, len(d) + 1), lambda i:
         len(list_filter(d[1:i - 1], lambda x: x = '{{')) - len(list_filter(d[1:i - 1], lambda x: x = '}}'))) AS depth FROM cb),
co AS (SELECT *, list_transform(range(1, len(d) + 1), lambda i:
         list_max(list_filter(range(1, i), lambda j: d[j] = '{{' AND depth[j] = depth[i] - 1))) AS opener FROM cd),
cls AS (SELECT scan_id, path, coalesce(list_bool_or(list_transform(range(1, len(d) + 1), lambda i:
          opener[i] IS NOT NULL AND regexp_matches(s[opener[i]], '(^|[^A-Za-z0-9_$.])class([^A-Za-z0-9_$][^;]*)?$')
          AND (regexp_matches(regexp_replace(regexp_replace(s[i], '\\([^()]*\\)', '()', 'g'), '\\s+$', ''), '{_sqlq(_FIELD_RE2)}(=([^=>]|$)|;)')
               OR (d[i] = '}}' AND regexp_matches(regexp_replace(regexp_replace(s[i], '\\([^()]*\\)', '()', 'g'), '\\s+$', ''), '{_sqlq(_FIELD_RE2)}$'))))), false) AS hit FROM co)
SELECT DISTINCT scan_id, file, feature FROM (
  {' UNION ALL '.join(f"SELECT scan_id, path AS file, '{k}' AS feature FROM f WHERE regexp_matches(c, '{_sqlq(p)}')" for k, p in _JS_RE2.items())}
  UNION ALL SELECT scan_id, path, 'top-level-await' FROM tla WHERE hit
  UNION ALL SELECT scan_id, path, 'class-fields' FROM cls WHERE hit
  UNION ALL SELECT scan_id, path, unnest(regexp_extract_all(raw, '{_sqlq(D.CORE_JS_IMPORT)}', 1)) FROM f
    WHERE contains(raw, 'core-js/'))
"""
ORACLE["DET-01"] = DET01_SQL
ORACLE["DET-03"] = f"""
SELECT scan_id, array_to_string(list_sort(list(DISTINCT feature)), ',') AS features FROM (
  SELECT scan_id, feature FROM ({DET01_SQL}) UNION ALL SELECT scan_id, feature FROM ({DET02_SQL}))
GROUP BY scan_id
"""
