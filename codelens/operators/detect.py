"""Detectors (DET-*): per-file predicates and per-scan signals.

All per-file rules run as **one pass** over ``files``: a literal array of
``when(content.rlike(LITERAL), struct(rule…))``, compacted and exploded.
Patterns are literals, so each is compiled once per task; no file is joined
to a pattern table.  Per-scan signals (policies, frameworks) are
``groupBy(scan_id).agg(max(flag))`` — partial aggregation, one row per scan.

Regex notes: Spark's ``\\b`` is Unicode-aware, the scanned application's is
ASCII, so word boundaries are spelled out as character classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens import rules
from codelens.functions.lexer import code_column, strip_css
from codelens.functions.scalar import basename, ext as ext_of

ID = "A-Za-z0-9_$"
NB = f"(^|[^{ID}])"      # not preceded by an identifier character
NA = f"([^{ID}]|$)"      # not followed by an identifier character


def rule_array(rules_: list[tuple[Column, dict]]) -> Column:
    """``array_compact(array(when(cond, struct(fields)), …))``."""
    return F.array_compact(F.array(*[
        F.when(cond, F.struct(*[F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k)
                                for k, v in fields.items()]))
        for cond, fields in rules_]))


def explode_rules(arr: Column, alias: str) -> Column:
    """``explode_outer`` of a rule array.  Plain ``explode`` makes Catalyst
    infer ``size(arr) > 0`` and push it below the projection, which evaluates
    the whole rule array a second time (outside codegen); callers drop the
    NULL row of an empty array with ``filter(col.isNotNull())``."""
    return F.explode_outer(arr).alias(alias)


def with_path_cols(files: DataFrame) -> DataFrame:
    """Add ``basename``/``ext`` when missing (corpus tables carry them)."""
    f = files
    if "basename" not in f.columns:
        f = f.withColumn("basename", basename(F.col("path")))
    if "ext" not in f.columns:
        f = f.withColumn("ext", ext_of(F.col("path")))
    return f


# -- DET-01: JS / TS features --------------------------------------------------

CORE_JS_IMPORT = r"""(?:^|[\n;])\s*import\s+(?:[^'";]*?\s+from\s+)?['"](core-js/[^'"]+)['"]"""
AWAIT_SPLIT = rf"(?<![{ID}.])await(?![{ID}])"


def _brace_delta(seg: Column) -> Column:
    return (F.length(seg) - F.length(F.regexp_replace(seg, r"\{", ""))) - \
           (F.length(seg) - F.length(F.regexp_replace(seg, r"\}", "")))


def top_level_await(code: Column) -> Column:
    """True when some ``await`` sits at brace depth 0.

    The code is split at each ``await``; a running brace balance over the
    segments before each one gives its depth.  Approximation of "no enclosing
    function": an ``await`` inside a top-level block ``{}`` is missed and a
    brace-less async arrow at depth 0 is counted."""
    segs = F.split(code, AWAIT_SPLIT)
    before = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    init = F.struct(F.lit(0).cast("long").alias("d"), F.lit(False).alias("hit"))
    acc = F.aggregate(before, init, lambda a, s: F.struct(
        (a["d"] + _brace_delta(s)).alias("d"), (a["hit"] | ((a["d"] + _brace_delta(s)) <= 0)).alias("hit")))
    return acc["hit"]


# (feature, literal every match contains, pattern).  The literal is checked
# first with a plain substring search; the regex only runs on texts that
# contain it (a leading non-identifier group defeats the regex engine's
# literal skip-ahead, so an unguarded rule costs a full backtracking scan).
JS_RULES = [
    ("navigator.clipboard", "clipboard", rf"{NB}navigator\s*\??\.\s*clipboard{NA}"),
    ("WebShare", "share", rf"{NB}navigator\s*\??\.\s*share{NA}"),
    ("CustomElements", "customElements", rf"{NB}window\s*\??\.\s*customElements{NA}"),
    ("fetch", "fetch", rf"(^|[^{ID}.])fetch\s*\("),
    ("promise-allSettled", "allSettled", rf"{NB}Promise\s*\??\.\s*allSettled\s*\("),
    ("string-replaceAll", "replaceAll", r"\.\s*replaceAll\s*\("),
    ("XMLHttpRequest", "XMLHttpRequest", rf"{NB}new\s+XMLHttpRequest{NA}"),
    ("Worker", "Worker", rf"{NB}new\s+Worker{NA}"),
    ("SharedWorker", "SharedWorker", rf"{NB}new\s+SharedWorker{NA}"),
    ("IntersectionObserver", "IntersectionObserver", rf"{NB}new\s+IntersectionObserver{NA}"),
    ("ResizeObserver", "ResizeObserver", rf"{NB}new\s+ResizeObserver{NA}"),
    ("AbortController", "AbortController", rf"{NB}new\s+AbortController{NA}"),
    ("dynamic-import", "import", rf"(^|[^{ID}.])import\s*\("),
    ("async-await", "await", rf"(^|[^{ID}.])await{NA}"),
    ("optional-chaining", "?.", r"\?\.\s*[A-Za-z_$\[]"),
    ("nullish-coalescing", "??", r"\?\?(?!=)"),
    ("private-class-fields", "#", rf"(^|[^{ID}])#[A-Za-z_$]"),
]


def guarded(text: Column, literal: str, pattern: str, ci: bool = False) -> Column:
    """``text rlike pattern`` evaluated only when ``literal`` occurs in text
    (case-insensitively when ``ci``); the literal must be part of every match."""
    probe = F.lower(text).contains(literal.lower()) if ci else text.contains(literal)
    return probe & text.rlike(pattern)


def _scopes(text: Column, inside, found) -> Column:
    """Whether ``found(segment, delimiter)`` holds for some segment that stands
    directly in a scope of interest.

    The text is read as segments between braces; a stack remembers for every open
    brace whether ``inside(segment before it)`` held, so only depth 1 below such a
    brace counts.  Segments are looked at one by one, whatever the text's length.
    """
    segs = F.regexp_extract_all(text, F.lit(r"[^{}]*(?:[{}]|$)"), 0)
    start = F.struct(F.array().cast("array<boolean>").alias("stack"), F.lit(False).alias("hit"))

    def step(acc: Column, seg: Column) -> Column:
        last = F.right(seg, F.lit(1))
        body = F.regexp_replace(seg, r"[{}]$", "")
        top = F.coalesce(F.try_element_at(acc["stack"], F.lit(-1)), F.lit(False))
        stack = (F.when(last == "{", F.concat(acc["stack"], F.array(inside(body))))
                 .when(last == "}", F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0))))
                 .otherwise(acc["stack"]))
        return F.struct(stack.alias("stack"), (acc["hit"] | (top & found(body, last))).alias("hit"))

    return F.aggregate(segs, start, step, lambda acc: acc["hit"])


CLASS_HEAD = rf"(^|[^{ID}.])class(?![{ID}])[^;]*$"
FIELD_NAME = (r"(?:^|[;\n])\s*(?:(?:public|private|protected|readonly|static|declare|override)\s+)*[A-Za-z_$][\w$]*[?!]?\s*"
              r"(?::[^;=(){}]+)?")
FIELD = FIELD_NAME + r"(?:=(?![=>])|;)"
LAST_FIELD = FIELD_NAME + r"$"


def class_fields(code: Column) -> Column:
    """True when a field is declared directly in a class body (not in a method):
    a name, then ``=``, ``;`` or the end of the body.  Argument lists are blanked,
    so method signatures and their defaults are no fields."""
    def found(seg: Column, last: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(seg, r"\([^()]*\)", "()"), r"\s+$", "")
        return plain.rlike(FIELD) | ((last == "}") & plain.rlike(LAST_FIELD))
    return _scopes(code, lambda seg: seg.rlike(CLASS_HEAD), found)


def js_features(code_raw: Column, stripped: Column) -> Column:
    """ARRAY<STRING> of feature keys for one JS/TS source text.

    ``stripped`` is the text without comments and literals, as a projected column
    (``lexer.code_column``): it is made once per row, and all rules read it."""
    c = stripped
    base = F.array_compact(F.array(*[F.when(guarded(c, lit, p), F.lit(k)) for k, lit, p in JS_RULES]))
    tla = F.when(c.contains("await") & top_level_await(c),
                 F.array(F.lit("top-level-await"))).otherwise(F.array().cast("array<string>"))
    cls = F.when(guarded(c, "class", rf"{NB}class{NA}") & class_fields(c),
                 F.array(F.lit("class-fields"))).otherwise(F.array().cast("array<string>"))
    raw = F.coalesce(code_raw, F.lit(""))
    core = F.when(raw.contains("core-js/"), F.regexp_extract_all(raw, F.lit(CORE_JS_IMPORT), 1)).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.concat(base, tla, cls, core))


def detect_js(files: DataFrame) -> DataFrame:
    """DET-01: ``(scan_id, file, feature)`` for ``.js .jsx .ts .tsx`` files."""
    f = with_path_cols(files).filter(F.col("ext").isin(*rules.JS_EXTS))
    g = code_column(f.select("scan_id", "path", "content"))
    g = g.select("scan_id", F.col("path").alias("file"), js_features(F.col("content"), F.col("_code")).alias("_f"))
    return g.select("scan_id", "file", explode_rules(F.col("_f"), "feature")).filter(F.col("feature").isNotNull())


# -- DET-02: CSS / SCSS features ------------------------------------------------
CSS_DECL = r"[{;}]\s*(-?-?[A-Za-z][\w-]*)\s*:\s*([^;{}]*)(?=[;}])"


def css_nesting(css: Column) -> Column:
    """True when a rule whose selector has ``&`` stands directly in another rule
    (not in an at-rule)."""
    def selector(seg: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(seg, r"[^;]*$", 0), r"^\s+|\s+$", "")

    def rule(seg: Column) -> Column:
        return ~selector(seg).startswith("@")
    return _scopes(css, rule, lambda seg, last: (last == "{") & rule(seg) & selector(seg).contains("&"))


def css_features(css_raw: Column, scss: Column | None = None) -> Column:
    """ARRAY<STRING> of feature keys for one style sheet; where ``scss`` holds, ``//`` opens a comment."""
    css = strip_css(F.coalesce(css_raw, F.lit("")), scss)
    props = F.regexp_extract_all(css, F.lit(CSS_DECL), 1)
    vals = F.regexp_extract_all(css, F.lit(CSS_DECL), 2)
    decls = F.arrays_zip(props.alias("p"), vals.alias("v"))

    def any_decl(pred):
        return F.exists(decls, lambda d: pred(F.trim(d["p"]), d["v"]))
    rules_ = [
        ("css-has-pseudo", css.contains(":has(")),
        ("css-nesting", css.contains("&") & css_nesting(css)),
        ("css-variables", any_decl(lambda p, v: p.startswith("--"))),
        ("css-backdrop-filter", any_decl(lambda p, v: p == "backdrop-filter")),
        ("css-grid", any_decl(lambda p, v: p.contains("grid"))),
        ("css-subgrid", any_decl(lambda p, v: p.isin("grid-template-columns", "grid-template-rows")
                                 & v.contains("subgrid"))),
        ("css-flexbox", any_decl(lambda p, v: p.contains("flex"))),
        ("css-clamp", any_decl(lambda p, v: v.contains("clamp("))),
        ("css-container-queries", guarded(css, "@container", r"@container([^A-Za-z0-9_-]|$)")),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in rules_]))


def detect_css(files: DataFrame) -> DataFrame:
    """DET-02: ``(scan_id, file, feature)`` for ``.css .scss`` files."""
    f = with_path_cols(files).filter(F.col("ext").isin(*rules.CSS_EXTS))
    return f.select("scan_id", F.col("path").alias("file"),
                    explode_rules(css_features(F.col("content"), F.col("ext") == ".scss"), "feature")).filter(F.col("feature").isNotNull())


def detect_features(files: DataFrame) -> DataFrame:
    """DET-01 + DET-02 in one scan of the corpus, distinct per file."""
    f = with_path_cols(files).filter(F.col("ext").isin(*(rules.JS_EXTS + rules.CSS_EXTS)))
    is_js = F.col("ext").isin(*rules.JS_EXTS)
    g = code_column(f.select("scan_id", "path", "ext", "content"), when=is_js)
    feats = F.when(is_js, js_features(F.col("content"), F.col("_code"))).otherwise(
        css_features(F.col("content"), F.col("ext") == ".scss"))
    g = g.select("scan_id", F.col("path").alias("file"), feats.alias("_f"))
    return g.select("scan_id", "file", explode_rules(F.col("_f"), "feature")).filter(F.col("feature").isNotNull())


def project_features(features: DataFrame) -> DataFrame:
    """DET-03: per scan sorted distinct feature list (bounded by the rule
    vocabulary plus core-js import paths)."""
    return features.groupBy("scan_id").agg(F.array_sort(F.collect_set("feature")).alias("features"))


# -- DET-17..22: security rule array ------------------------------------------
SECURITY_EXTS = [".js", ".jsx", ".ts", ".tsx", ".html"]


def security_rules(c: Column, fname: Column) -> list[tuple[Column, dict]]:
    """(condition, finding) pairs for one file's content; finding kinds are
    ``insecure_api``, ``missing_policy``, ``inefficient`` and ``sensitive``."""
    def f(kind, title, sev, desc):
        return {"kind": kind, "title": title, "severity": sev,
                "description": F.concat(F.lit(desc + " "), fname)}
    cookie = guarded(c, "res.cookie", r"(?i)res\.cookie\s*\(", ci=True)
    session = guarded(c, "express-session", r"""(?i)require\(['"]express-session['"]\)|from\s+['"]express-session['"]""", ci=True)
    return [
        (guarded(c, "http://", r"(?i)http://", ci=True), f("insecure_api", "Insecure HTTP usage", "High", "Found http:// reference in")),
        (guarded(c, "cors", r"(?i)app\.use\(\s*cors\s*\(\s*\)\s*\)", ci=True)
         | guarded(c, "origin", r"""(?i)origin\s*:\s*['"][*]['"]""", ci=True),
         f("missing_policy", "Permissive CORS", "Medium", "Wildcard CORS policy in")),
        (guarded(c, "credentials", r"""(?i)cors\s*\(\s*\{[^}]*origin\s*:\s*['"][*]['"][^}]*credentials\s*:\s*true""", ci=True),
         f("missing_policy", "Permissive CORS with credentials", "High", "Wildcard origin and credentials=true in")),
        (guarded(c, "cors", r"""(?i)cors\s*\(\s*\{[^}]*(allowedHeaders|methods)\s*:\s*['"][*]['"]""", ci=True),
         f("missing_policy", "Wildcard CORS headers/methods", "Medium", "Wildcard headers or methods in")),
        (guarded(c, "Sync(", r"fs\.[a-zA-Z]+Sync\(") | c.contains("execSync(") | c.contains("spawnSync("),
         f("inefficient", "Blocking I/O", "Medium", "Synchronous operation in")),
        (guarded(c, "eval", r"eval\s*\(") | guarded(c, "Function", r"new\s+Function\s*\("),
         f("inefficient", "Dynamic code execution", "High", "Use of eval/new Function in")),
        (guarded(c, "document.write", r"document\.write\s*\(") | guarded(c, "innerHTML", r"dangerouslySetInnerHTML\s*:\s*")
         | guarded(c, "innerHTML", r"innerHTML\s*="),
         f("insecure_api", "Potential XSS risk", "Medium", "Direct HTML injection pattern in")),
        (cookie & ~c.rlike(r"(?i)httpOnly\s*:\s*true"),
         f("insecure_api", "Cookie without httpOnly", "Medium", "res.cookie missing httpOnly in")),
        (cookie & ~c.rlike(r"(?i)secure\s*:\s*true"),
         f("insecure_api", "Cookie without secure", "Low", "res.cookie missing secure in")),
        (session & ~(c.rlike(r"(?i)cookie\s*:\s*\{[^}]*secure\s*:\s*true")
                     & c.rlike(r"(?i)cookie\s*:\s*\{[^}]*httpOnly\s*:\s*true")),
         f("missing_policy", "Session cookie flags", "Medium", "express-session cookies missing secure/httpOnly in")),
        (guarded(c, "AKIA", r"AKIA[0-9A-Z]{16}") | guarded(c, "-----BEGIN", r"-----BEGIN\s+PRIVATE\s+KEY-----"),
         f("sensitive", "Sensitive file", "High", "Secret pattern in")),
    ]


def detect_security(files: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """DET-17..22: ``(scan_id, file, kind, title, severity, description)`` —
    one pass, one rule array per code file."""
    f = with_path_cols(files).filter(F.col("ext").isin(*(exts or SECURITY_EXTS)))
    c = F.coalesce(F.col("content"), F.lit(""))
    arr = rule_array(security_rules(c, F.col("basename")))
    return f.select("scan_id", F.col("path").alias("file"), explode_rules(arr, "r")).filter(
        F.col("r").isNotNull()).select("scan_id", "file", "r.kind", "r.title", "r.severity", "r.description")


# FIXED VALUES: sensitive file-name fragments (DET-23)
SENSITIVE_NAME_PARTS = [".npmrc", ".yarnrc", "credentials", ".env"]


def sensitive_files(files: DataFrame, security: DataFrame | None = None) -> DataFrame:
    """DET-23 (+DET-22): distinct basenames containing a sensitive fragment,
    unioned with files whose content matched a secret pattern."""
    f = with_path_cols(files)
    b = F.col("basename")
    cond = F.lit(False)
    for part in SENSITIVE_NAME_PARTS:
        cond = cond | b.contains(part)
    by_name = f.filter(cond).select("scan_id", b.alias("name"))
    if security is not None:
        by_content = security.filter(F.col("kind") == "sensitive").select("scan_id", basename(F.col("file")).alias("name"))
        by_name = by_name.unionByName(by_content)
    return by_name.distinct()


def large_assets(files: DataFrame, kb: int = 100) -> DataFrame:
    """DET-24: files above ``kb`` KiB with the size rounded to whole KB."""
    f = with_path_cols(files).filter(F.col("size") > kb * 1024)
    kbs = F.floor(F.col("size") / 1024 + 0.5).cast("long")
    return f.select("scan_id", F.col("path").alias("file"), "size", kbs.alias("kb"),
                    F.lit("Large asset").alias("title"), F.lit("Low").alias("severity"),
                    F.concat(F.col("basename"), F.lit(" — "), kbs.cast("string"), F.lit(" KB")).alias("description"))


def bottlenecks(large: DataFrame, kb: int = 100) -> DataFrame:
    """DET-25: one 'Multiple large assets' finding per scan with more than 3."""
    return large.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 3).select(
        "scan_id", F.lit("Multiple large assets").alias("title"), F.lit("Low").alias("severity"),
        F.concat(F.col("n").cast("string"), F.lit(f" assets exceed {kb}KB")).alias("description"))


# -- DET-26: policy gaps ----------------------------------------------------------
# signal -> (lower-case literals, one of which every match contains; pattern)
POLICY_SIGNALS = {
    "express": (["express"], r"""(?i)require\(['"]express['"]\)|from\s+['"]express['"]"""),
    "helmet_import": (["helmet"], r"""(?i)require\(['"]helmet['"]\)|from\s+['"]helmet['"]"""),
    "helmet_use": (["helmet"], r"(?i)helmet\s*\("),
    "csp": (["contentsecuritypolicy", "csp"], r"(?i)contentsecuritypolicy|csp"),
    "frameguard": (["frameguard"], r"(?i)frameguard"),
    "nosniff": (["nosniff", "x-content-type-options"], r"(?i)nosniff|x-content-type-options"),
    "referrer": (["referrerpolicy"], r"(?i)referrerpolicy"),
    "hsts": (["hsts", "stricttransportsecurity"], r"(?i)hsts|stricttransportsecurity"),
    "permissions": (["permissionspolicy", "feature-policy"], r"(?i)permissionspolicy|feature-policy"),
    "no_xpb": (["x-powered-by"], r"""(?i)app\.disable\(\s*['"]x-powered-by['"]\s*\)"""),
    "csurf_import": (["csurf"], r"""(?i)require\(['"]csurf['"]\)|from\s+['"]csurf['"]"""),
    "csurf_use": (["csurf"], r"(?i)csurf\s*\("),
    "ratelimit_import": (["express-rate-limit"], r"""(?i)require\(['"]express-rate-limit['"]\)|from\s+['"]express-rate-limit['"]"""),
    "ratelimit_use": (["ratelimit"], r"(?i)rateLimit\s*\("),
}
# FIXED VALUES: header policies (signal, title, description, severity)
HEADER_POLICIES = [
    ("csp", "CSP", "Content Security Policy not configured", "High"),
    ("hsts", "HSTS", "Strict-Transport-Security not enforced", "High"),
    ("frameguard", "X-Frame-Options", "Frameguard missing (clickjacking protection)", "Medium"),
    ("nosniff", "X-Content-Type-Options", "MIME sniffing protection missing (noSniff)", "Medium"),
    ("referrer", "Referrer-Policy", "Referrer policy not set", "Low"),
    ("permissions", "Permissions-Policy", "Permissions policy not set", "Low"),
]


def policy_signals(files: DataFrame) -> DataFrame:
    f = with_path_cols(files).filter(F.col("ext").isin(*SECURITY_EXTS))
    c = F.coalesce(F.col("content"), F.lit(""))
    low = F.lower(c)

    def sig(lits, p):
        probe = F.lit(False)
        for lit in lits:
            probe = probe | low.contains(lit)
        return probe & c.rlike(p)
    return f.groupBy("scan_id").agg(*[F.max(sig(lits, p).cast("int")).alias(k) for k, (lits, p) in POLICY_SIGNALS.items()])


def policy_gaps(files: DataFrame) -> DataFrame:
    """DET-26: missing policies for scans that import express.  Without both
    helmet import and use, all six header policies are missing (CSP with the
    helmet wording); otherwise each is missing unless mentioned.  Then
    X-Powered-By, CSRF and rate limiting."""
    s = policy_signals(files).filter(F.col("express") == 1)
    no_helmet = (F.col("helmet_import") == 0) | (F.col("helmet_use") == 0)
    rs = []
    for sig, title, desc, sev in HEADER_POLICIES:
        d = F.when(no_helmet & F.lit(sig == "csp"), F.lit("Content Security Policy not configured (helmet)")).otherwise(F.lit(desc))
        rs.append((no_helmet | (F.col(sig) == 0), {"title": title, "description": d, "severity": sev}))
    rs += [
        (F.col("no_xpb") == 0, {"title": "X-Powered-By", "description": "X-Powered-By header not disabled", "severity": "Low"}),
        ((F.col("csurf_import") == 0) | (F.col("csurf_use") == 0),
         {"title": "CSRF", "description": "CSRF protection not configured", "severity": "High"}),
        ((F.col("ratelimit_import") == 0) | (F.col("ratelimit_use") == 0),
         {"title": "Rate limiting", "description": "Express rate limiting not configured", "severity": "Medium"}),
    ]
    return s.select("scan_id", F.explode(rule_array(rs)).alias("r")).select(
        "scan_id", "r.title", "r.description", "r.severity")


# -- DET-27/28: CI workflows --------------------------------------------------------
WORKFLOW_PATH = r"(^|/)\.github/workflows/"
USES = r"(?i)uses\s*:\s*([^\s]+)@([^\s]+)"


def ci_findings(files: DataFrame) -> DataFrame:
    """DET-27 + DET-28: workflow findings ``(scan_id, file, title, severity,
    description)``; one unpinned-action finding per ``uses:`` occurrence."""
    f = with_path_cols(files)
    p = F.regexp_replace("path", r"\\", "/")
    wf = f.filter(p.rlike(WORKFLOW_PATH) & F.col("ext").isin(".yml", ".yaml"))
    c = F.coalesce(F.col("content"), F.lit(""))
    low = F.lower(c)

    def fd(title, sev, desc):
        return {"title": title, "severity": sev, "description": F.lit(desc)}
    rs = [
        (low.rlike(r"(^|[^a-z0-9_])on\s*:\s*[\s\S]*pull_request_target([^a-z0-9_]|$)"),
         fd("Workflow triggered by pull_request_target", "High",
            "pull_request_target runs with elevated permissions; prefer pull_request with least privileges.")),
        (~c.rlike(r"(?i)\n\s*permissions\s*:"),
         fd("Missing explicit permissions for GITHUB_TOKEN", "Medium",
            "Define permissions: at workflow/job level to enforce least privilege.")),
        (c.rlike(r"(?i)runs-on\s*:\s*self-hosted"),
         fd("Self-hosted runner used", "Medium", "Ensure self-hosted runners are trusted and hardened.")),
        (c.rlike(r"(?i)uses\s*:\s*actions/checkout@") & ~c.rlike(r"(?i)persist-credentials\s*:\s*false"),
         fd("Checkout persists credentials", "Medium",
            "Set with: persist-credentials: false to avoid leaking GITHUB_TOKEN.")),
    ]
    fixed = wf.select("scan_id", F.col("basename").alias("file"), explode_rules(rule_array(rs), "r")).filter(
        F.col("r").isNotNull()).select(
        "scan_id", "file", "r.title", "r.severity", "r.description")
    uses = wf.select("scan_id", F.col("basename").alias("file"),
                     F.posexplode(F.arrays_zip(F.regexp_extract_all(c, F.lit(USES), 1).alias("a"),
                                               F.regexp_extract_all(c, F.lit(USES), 2).alias("v"))).alias("i", "u"))
    unpinned = uses.filter(~F.col("u.v").rlike(r"(?i)^[0-9a-f]{7,40}$")).select(
        "scan_id", "file", F.lit("Unpinned action version").alias("title"), F.lit("Medium").alias("severity"),
        F.concat(F.lit("Action "), F.col("u.a"), F.lit("@"), F.col("u.v"), F.lit(" not pinned to commit SHA.")).alias("description"))
    return fixed.unionByName(unpinned)


# -- DET-14..16: configs, build tools, framework fallbacks ----------------------
def detect_configs(files: DataFrame) -> DataFrame:
    """DET-14: distinct config files present per scan (fixed name list)."""
    f = with_path_cols(files)
    return f.filter(F.col("basename").isin(*rules.CONFIG_FILE_NAMES)).select(
        "scan_id", F.col("basename").alias("name")).distinct()


def build_tools(configs: DataFrame) -> DataFrame:
    """DET-15: build tools implied by config files (distinct)."""
    m = F.create_map(*[x for cfg, tool in rules.BUILD_TOOL_RULES for x in (F.lit(cfg), F.lit(tool))])
    return configs.select("scan_id", m[F.col("name")].alias("name")).filter(F.col("name").isNotNull()).distinct()


def frameworks_from_configs(configs: DataFrame) -> DataFrame:
    """DET-16: framework fallbacks implied by config files (distinct)."""
    m = F.create_map(*[x for cfg, fw in rules.CONFIG_FRAMEWORK_RULES for x in (F.lit(cfg), F.lit(fw))])
    return configs.select("scan_id", m[F.col("name")].alias("name")).filter(F.col("name").isNotNull()).distinct()


# -- DET-04..13: frameworks from manifests and file layout ---------------------
PY_JAVA_MANIFESTS = r"(^|/)(requirements\.txt|Pipfile|pyproject\.toml|setup\.py|pom\.xml|build\.gradle|build\.gradle\.kts)$"
GO_FRAMEWORKS = [
    (r"github\.com/gin-gonic/gin", "Go (Gin)"), (r"github\.com/labstack/echo", "Go (Echo)"),
    (r"github\.com/gofiber/fiber", "Go (Fiber)"), (r"github\.com/go-chi/chi", "Go (Chi)"),
    (r"github\.com/gorilla/mux", "Go (Gorilla Mux)"), (r"gorm\.io/gorm", "GORM"),
]
ML_ARTIFACT_EXTS = [".h5", ".onnx", ".pt", ".pth", ".joblib", ".pkl"]


def framework_signals(files: DataFrame) -> DataFrame:
    """Per-scan boolean signals for DET-04..13 (one grouped aggregate)."""
    from codelens.sources.manifests import PKG_SCHEMA
    f = with_path_cols(files).withColumn("p", F.regexp_replace("path", r"\\", "/"))
    p, b, e = F.col("p"), F.col("basename"), F.col("ext")
    c = F.coalesce(F.col("content"), F.lit(""))
    low = F.lower(c)
    is_pkg = (b == "package.json") & ~p.contains("node_modules")
    root_pkg = p == "package.json"
    pkg = F.from_json(F.when(is_pkg, c), PKG_SCHEMA)
    deps, dev = pkg["dependencies"], pkg["devDependencies"]
    none = F.array().cast("array<string>")  # key arrays, not one map: a package may be in both
    names = F.concat(F.coalesce(F.map_keys(deps), none), F.coalesce(F.map_keys(dev), none))
    scripts = F.array_join(F.coalesce(F.map_values(pkg["scripts"]), F.array().cast("array<string>")), " ")

    def has(m, k):
        return F.coalesce(m[k].isNotNull(), F.lit(False))

    def word(w):
        return rf"(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)"
    code = e.isin(*rules.JS_EXTS)
    sig = {
        "react": root_pkg & (has(deps, "react") | has(dev, "react")),
        "angular_dep": root_pkg & (has(deps, "angular") | has(dev, "angular")),
        "vue_dep": root_pkg & (has(deps, "vue") | has(dev, "vue")),
        "express_dep": root_pkg & has(deps, "express"),
        "next_dep": root_pkg & has(deps, "next"),
        "angular_any": is_pkg & (scripts.rlike(word("ng")) | has(deps, "@angular/core") | has(dev, "@angular/core")),
        "angular_json": b == "angular.json",
        "flask": p.rlike(PY_JAVA_MANIFESTS) & low.contains("flask"),
        "fastapi": p.rlike(PY_JAVA_MANIFESTS) & low.contains("fastapi"),
        "django": p.rlike(PY_JAVA_MANIFESTS) & low.contains("django"),
        "spring": p.rlike(PY_JAVA_MANIFESTS) & low.rlike("spring-boot|springframework"),
        "hibernate": p.rlike(PY_JAVA_MANIFESTS) & low.contains("hibernate"),
        "jpa": p.rlike(PY_JAVA_MANIFESTS) & low.rlike(r"jakarta\.persistence|javax\.persistence"),
        "next": p.isin("next.config.js", "next.config.mjs")
        | (root_pkg & (F.array_contains(names, "next") | scripts.rlike(word("next"))))
        | p.startswith("pages/") | p.startswith("app/")
        | (code & c.contains("next/") & c.rlike(r"""from\s+['"]next/(link|router|head)['"]""")),
        "sveltekit": (root_pkg & F.array_contains(names, "@sveltejs/kit")) | p.startswith("src/routes/"),
        "svelte": p.isin("svelte.config.js", "svelte.config.mjs") | (root_pkg & F.array_contains(names, "svelte"))
        | (e == ".svelte"),
        "nuxt": p.isin("nuxt.config.js", "nuxt.config.ts", "nuxt.config.mjs", "nuxt.config.cjs")
        | (root_pkg & (F.array_contains(names, "nuxt") | scripts.rlike(word("(nuxt|nuxi)"))))
        | p.startswith("pages/") | p.startswith("src/pages/") | (p == "app.vue") | p.startswith("server/"),
        "vue": p.isin("vue.config.js", "vue.config.ts", "vue.config.mjs", "vue.config.cjs")
        | (root_pkg & (F.array_contains(names, "vue") | F.array_contains(names, "@vue/cli-service")
                       | scripts.rlike(word("vue-cli-service"))))
        | (p.isin("src/main.js", "src/main.ts") & c.rlike(r"""from\s+['"]vue['"]"""))
        | (p.startswith("src/") & (e == ".vue")),
        "nx": p.isin("nx.json", "workspace.json")
        | (root_pkg & F.exists(names, lambda n: (n == "nx") | n.startswith("@nrwl/")))
        | ((b == "project.json") & (F.get_json_object(c, "$.projectType").isNotNull()
                                    | F.get_json_object(c, "$.sourceRoot").isNotNull()
                                    | F.get_json_object(c, "$.targets").isNotNull())),
        "tensorflow": (e == ".py") & low.contains("tensorflow") & low.rlike(r"(^|[^a-z0-9_])(import|from)\s+tensorflow([^a-z0-9_]|$)"),
        "pytorch": (e == ".py") & low.contains("torch") & low.rlike(r"(^|[^a-z0-9_])(import|from)\s+torch([^a-z0-9_]|$)"),
        "keras": (e == ".py") & low.contains("keras") & low.rlike(r"(^|[^a-z0-9_])(import|from)\s+keras([^a-z0-9_]|$)"),
        "sklearn": (e == ".py") & low.contains("sklearn") & low.rlike(r"(^|[^a-z0-9_])(import|from)\s+sklearn([^a-z0-9_]|$)"),
        "notebook": e == ".ipynb",
        "ml_artifacts": e.isin(*ML_ARTIFACT_EXTS),
    }
    return f.groupBy("scan_id").agg(*[F.max(v.cast("int")).alias(k) for k, v in sig.items()])


FRAMEWORK_RULES = [
    ("react", "React"), ("angular_dep", "Angular"), ("vue_dep", "Vue"), ("express_dep", "Express"),
    ("next_dep", "Next.js"), ("angular_any", "Angular"), ("angular_json", "Angular"),
    ("flask", "Flask"), ("fastapi", "FastAPI"), ("django", "Django"), ("spring", "Spring Boot"),
    ("hibernate", "Hibernate"), ("jpa", "JPA"), ("next", "Next.js"), ("nuxt", "Nuxt"), ("vue", "Vue"),
    ("nx", "Nx"), ("tensorflow", "TensorFlow"), ("pytorch", "PyTorch"), ("keras", "Keras"),
    ("sklearn", "Scikit-learn"), ("notebook", "Jupyter Notebook"), ("ml_artifacts", "ML Artifacts"),
]


def detect_frameworks(files: DataFrame, go_requires: DataFrame | None = None) -> DataFrame:
    """DET-04..13: distinct ``(scan_id, name)`` frameworks.  SvelteKit
    supersedes Svelte; Go frameworks come from ``go.mod`` requires (SRC-16)."""
    s = framework_signals(files)
    rs = [(F.col(sig) == 1, {"name": name}) for sig, name in FRAMEWORK_RULES]
    rs += [(F.col("sveltekit") == 1, {"name": "SvelteKit"}),
           ((F.col("sveltekit") == 0) & (F.col("svelte") == 1), {"name": "Svelte"})]
    out = s.select("scan_id", F.explode(rule_array(rs)).alias("r")).select("scan_id", "r.name")
    if go_requires is not None:
        m = F.col("module")
        go = go_requires.select("scan_id", F.explode(F.array_compact(F.array(
            *[F.when(m.rlike(pat), F.lit(nm)) for pat, nm in GO_FRAMEWORKS]))).alias("name"))
        out = out.unionByName(go)
    return out.distinct()


# -- DET-29..37: classification and normalisation helpers -----------------------
def iac_checks(features: DataFrame, configs: DataFrame, max_files: int = 200) -> DataFrame:
    """DET-29: per scan terraform / kubernetes / docker flags from whole
    feature names (Q5: not substrings of the serialised list) and the sorted
    config list capped at ``max_files``."""
    fl = F.lower(F.col("feature"))
    fe = features.groupBy("scan_id").agg(
        F.max(fl.rlike(r"^terraform$").cast("int")).alias("has_terraform"),
        F.max(fl.isin("k8s", "kubernetes", "helm").cast("int")).alias("has_k8s"),
        F.max(fl.isin("docker", "container").cast("int")).alias("has_docker"))
    cf = configs.groupBy("scan_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, max_files).alias("files"))
    j = fe.join(cf, "scan_id", "full")
    return j.select("scan_id", *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ["has_terraform", "has_k8s", "has_docker"]],
                    F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def feature_domain(feature: Column) -> Column:
    """DET-30: ``css-``/``css.`` -> CSS; ``aria-``/``html-``/``data-`` -> HTML; else JS."""
    f = F.lower(feature)
    return (F.when(f.startswith("css-") | f.startswith("css."), "CSS")
            .when(f.startswith("aria-") | f.startswith("html-") | f.startswith("data-"), "HTML")
            .otherwise("JS"))


# FIXED VALUES: technology classification rules (DET-31)
UI_FRAMEWORK_PATTERN = r"(?i)react|angular|vue|svelte|next|nuxt|ember|solid|preact"
TEST_DEP_RULES = [("jest", "Jest"), ("mocha", "Mocha"), ("vitest", "Vitest"), ("karma", "Karma"),
                  ("jasmine", "Jasmine"), ("ava", "AVA"), ("cypress", "Cypress"), ("playwright", "Playwright")]
TEST_CONFIG_RULES = [(r"jest\.config\.js", "Jest"), (r"karma\.conf\.js", "Karma"), (r"protractor\.conf\.js", "Protractor")]
API_LAYER_RULES = [("express", "Express"), ("koa", "Koa"), ("fastify", "Fastify"), ("flask", "Flask"),
                   ("fastapi", "FastAPI"), ("django", "Django"), ("spring|spring-boot", "Spring Boot"),
                   ("hibernate", "Hibernate"), ("gin", "Gin"), ("fiber", "Fiber"), ("rails", "Rails"),
                   ("laravel", "Laravel")]
CICD_RULES = [(r"\.github/workflows/.+\.ya?ml$", "GitHub Actions"), (r"\.gitlab-ci\.ya?ml", "GitLab CI"),
              (r"azure-pipelines\.ya?ml", "Azure Pipelines"), (r"circleci/config\.ya?ml", "CircleCI")]


def tech_classes(deps: DataFrame, frameworks: DataFrame, configs: DataFrame) -> DataFrame:
    """DET-31: ``(scan_id, category, name)`` distinct — ui (framework name
    pattern), testing (dep / config patterns), api (first matching rule per
    dependency name), cicd (config path patterns)."""
    n = F.col("name")
    ui = frameworks.filter(n.rlike(UI_FRAMEWORK_PATTERN)).select("scan_id", F.lit("ui").alias("category"), "name")
    dn = deps.select("scan_id", "name").distinct()
    test_d = dn.select("scan_id", F.explode(F.array_compact(F.array(
        *[F.when(n.rlike("(?i)" + pat), F.lit(t)) for pat, t in TEST_DEP_RULES]))).alias("name"))
    test_c = configs.select("scan_id", F.explode(F.array_compact(F.array(
        *[F.when(n.rlike("(?i)" + pat), F.lit(t)) for pat, t in TEST_CONFIG_RULES]))).alias("name"))
    testing = test_d.unionByName(test_c).select("scan_id", F.lit("testing").alias("category"), "name")
    api_expr = F.lit(None).cast("string")
    for pat, t in reversed(API_LAYER_RULES):
        api_expr = F.when(n.rlike("(?i)" + pat), F.lit(t)).otherwise(api_expr)
    api = dn.select("scan_id", F.lit("api").alias("category"), api_expr.alias("name")).filter(F.col("name").isNotNull())
    cicd = configs.select("scan_id", F.explode(F.array_compact(F.array(
        *[F.when(n.rlike("(?i)" + pat), F.lit(t)) for pat, t in CICD_RULES]))).alias("name")).select(
        "scan_id", F.lit("cicd").alias("category"), "name")
    return ui.unionByName(testing).unionByName(api).unionByName(cicd).distinct()


def repo_identity(url: Column) -> Column:
    """DET-36: struct(provider, owner, repo) from a repository URL: provider
    ``github`` when the URL contains github.com, else ``unknown``; owner and
    repo are the two (shortest) segments after ``github.com/``, the repo ending
    at ``.git`` or the end of the text; NULL when the URL does not match."""
    u = F.coalesce(url, F.lit(""))
    provider = F.when(u.contains("github.com"), "github").otherwise("unknown")
    m = r"(?i)github\.com/(.*?)/(.*?)(?:\.git|$)"
    hit = u.rlike(m)
    owner = F.when(hit, F.regexp_extract(u, m, 1))
    repo = F.when(hit, F.regexp_extract(u, m, 2))
    return F.struct(provider.alias("provider"), owner.alias("owner"), repo.alias("repo"))


def upgrades(outdated: DataFrame) -> DataFrame:
    """DET-37: normalised ``(scan_id, package, from, to)``, only real changes."""
    cols = outdated.columns

    def pick(*names):
        present = [F.col(c) for c in names if c in cols]
        return F.coalesce(*present) if present else F.lit(None).cast("string")
    return outdated.select("scan_id", pick("package", "name").alias("package"),
                           pick("from", "current").alias("from_version"),
                           pick("to", "latest").alias("to_version")).filter(
        F.col("to_version").isNotNull() & (F.coalesce(F.col("from_version"), F.lit("")) != F.col("to_version")))
