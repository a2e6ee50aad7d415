"""Request validation, value visibility and shape normalisation (DET-32..35)
and policy-driven remediation suggestions (TXT-08).

All are column expressions evaluated inside the row; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.functions.scalar import js_trim

INPUT_TYPES = ["github", "url", "local", "zip"]
MAX_BASE64_LEN = 16_000_000
# Approximation of "valid URL with protocol": scheme http/https/ftp, a host
# with a dot (or localhost), optional port, no whitespace.
URL_RE = r"^(?i)(https?|ftp)://([A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(:[0-9]+)?([/?#][^\s]*)?$"


def _err(param: str, msg: str) -> Column:
    return F.struct(F.lit(param).alias("param"), F.lit(msg).alias("msg"))


def validate_requests(df: DataFrame) -> DataFrame:
    """DET-32: scan-request validation.  Adds ``errors`` (array of
    ``{param, msg}``, one per failed rule, in rule order) and ``valid``.

    Expected columns: inputType, repoUrl, localPath, zipBuffer (strings),
    branch (string), excludePaths (array<string>); missing optional columns
    are treated as absent."""
    cols = set(df.columns)

    def c(name, dtype="string"):
        return F.col(name) if name in cols else F.lit(None).cast(dtype)
    t = c("inputType")
    url, local, zipb, branch = c("repoUrl"), c("localPath"), c("zipBuffer"), c("branch")
    excl = c("excludePaths", "array<string>")
    is_url_type = t.isin("github", "url")
    checks = [
        (t.isNull(), _err("inputType", "inputType is required")),
        (t.isNull() | ~t.isin(*INPUT_TYPES), _err("inputType", "inputType must be one of github|url|local|zip")),
        (is_url_type & url.isNull(), _err("repoUrl", "repoUrl must be a string")),
        (is_url_type & ~F.coalesce(js_trim(url).rlike(URL_RE), F.lit(False)),
         _err("repoUrl", "repoUrl must be a valid URL with protocol")),
        ((t == "local") & local.isNull(), _err("localPath", "localPath must be a string")),
        ((t == "local") & (F.length(F.coalesce(js_trim(local), F.lit(""))) < 1),
         _err("localPath", "localPath is required for local scans")),
        ((t == "zip") & zipb.isNull(), _err("zipBuffer", "zipBuffer must be a base64 string")),
        ((t == "zip") & ~F.coalesce(zipb, F.lit("")).rlike(r"^[A-Za-z0-9+/=]+$"), _err("zipBuffer", "zipBuffer must be base64")),
        ((t == "zip") & (F.length(F.coalesce(zipb, F.lit(""))) > MAX_BASE64_LEN),
         _err("zipBuffer", "zipBuffer exceeds maximum allowed size")),
        (branch.isNotNull() & ~F.length(js_trim(branch)).between(1, 256),
         _err("branch", "branch must be between 1 and 256 characters")),
        (branch.isNotNull() & ~js_trim(branch).rlike(r"^[\w\-./]+$"), _err("branch", "branch contains invalid characters")),
        (excl.isNotNull() & F.exists(excl, lambda x: x.isNull() | ~F.length(js_trim(x)).between(1, 200)),
         _err("excludePaths", "excludePaths items must be non-empty strings")),
    ]
    errors = F.array_compact(F.array(*[F.when(cond, e) for cond, e in checks]))
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def _unknown_text(c: Column) -> Column:
    return F.lower(js_trim(c)).isin("unknown", "n/a", "na")


def meaningful(c: Column, dtype: T.DataType) -> Column:
    """DET-33: NULL, 'unknown'/'n/a'/'na', numeric 0 and blank strings are not
    meaningful; arrays are meaningful if any element is, structs and maps if
    any value is (recursively by type)."""
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & ~_unknown_text(c) & (F.length(js_trim(c)) > 0)
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    if isinstance(dtype, T.BooleanType):
        return c.isNotNull()
    if isinstance(dtype, T.ArrayType):
        return c.isNotNull() & F.exists(c, lambda x: meaningful(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return c.isNotNull() & F.exists(F.map_values(c), lambda x: meaningful(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        out = F.lit(False)
        for f in dtype.fields:
            out = out | F.coalesce(meaningful(c[f.name], f.dataType), F.lit(False))
        return c.isNotNull() & out
    return c.isNotNull() & (F.length(js_trim(c.cast("string"))) > 0)


def is_meaningful(df: DataFrame, col: str) -> Column:
    return F.coalesce(meaningful(F.col(col), df.schema[col].dataType), F.lit(False))


def section_visibility(df: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """DET-33: a section is shown when any of its columns is meaningful;
    ``hidden_sections`` counts the sections that are not."""
    shown = {name: F.lit(False) for name in sections}
    for name, cols in sections.items():
        for c in cols:
            shown[name] = shown[name] | is_meaningful(df, c)
    out = df.select("*", *[v.alias("show_" + k) for k, v in shown.items()])
    hidden = sum((~F.col("show_" + k)).cast("int") for k in sections)
    return out.withColumn("hidden_sections", hidden)


def normalize_features(df: DataFrame, col: str) -> DataFrame:
    """DET-34: a JSON value that is an array of strings, an array of
    ``{name}`` objects, or an object ``file -> [features]`` -> sorted distinct
    strings (``features``).  Non-string entries are dropped."""
    j = F.col(col)
    first = F.regexp_extract(j, r"^\s*(\S)", 1)
    arr = F.from_json(F.when(first == "[", j), "array<string>")
    from_arr = F.transform(arr, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name"))
                           .when(x.startswith("["), F.lit(None)).otherwise(x))
    mp = F.from_json(F.when(first == "{", j), "map<string,array<string>>")
    from_map = F.flatten(F.map_values(mp))
    vals = F.coalesce(from_arr, from_map, F.array().cast("array<string>"))
    return df.withColumn("features", F.array_sort(F.array_distinct(F.filter(vals, lambda x: x.isNotNull()))))


def normalize_vulns(df: DataFrame, col: str) -> DataFrame:
    """DET-35: vulnerability fields from their alternative names: name,
    title (``via[0]`` when via is a list), severity, range and fix
    (``name@version`` of a fix object, ``Available`` when truthy, else N/A)."""
    j = F.col(col)

    def g(path):
        return F.nullif(F.get_json_object(j, path), F.lit(""))
    fix_raw = F.get_json_object(j, "$.fixAvailable")
    fix = (F.when(g("$.fixAvailable.name").isNotNull(),
                  F.concat(g("$.fixAvailable.name"), F.lit("@"), F.coalesce(g("$.fixAvailable.version"), F.lit("undefined"))))
           .when(fix_raw.isNotNull() & ~fix_raw.isin("false", "0", "", "null"), F.lit("Available"))
           .otherwise(F.lit("N/A")))
    via0 = F.when(F.get_json_object(j, "$.via").startswith("["), g("$.via[0]"))
    return df.select(
        "*",
        F.coalesce(g("$.module_name"), g("$.name"), g("$.package"), g("$.dependency"), F.lit("Unknown Package")).alias("vuln_name"),
        F.coalesce(g("$.title"), g("$.problem"), g("$.advisoryTitle"), via0, F.lit("Security vulnerability")).alias("vuln_title"),
        F.coalesce(g("$.severity"), g("$.level"), F.lit("unknown")).alias("vuln_severity"),
        F.coalesce(g("$.range"), g("$.vulnerable_versions"), g("$.version"), F.lit("")).alias("vuln_range"),
        fix.alias("vuln_fix"))


# FIXED VALUES: remediation files (TXT-08): (file, category, severity, lines)
DEPENDABOT = (".github/dependabot.yml", "secure", "Medium", [
    "version: 2",
    "updates:",
    '  - package-ecosystem: "npm"',
    '    directory: "/"',
    "    schedule:",
    '      interval: "weekly"',
    "    open-pull-requests-limit: 5",
    "    commit-message:",
    '      prefix: "deps"',
])
CODEQL = (".github/workflows/codeql.yml", "secure", "Medium", [
    'name: "CodeQL"',
    "on:",
    "  push:",
    '    branches: [ "main" ]',
    "  pull_request:",
    '    branches: [ "main" ]',
    "jobs:",
    "  analyze:",
    "    runs-on: ubuntu-latest",
    "    permissions:",
    "      security-events: write",
    "    steps:",
    "    - uses: actions/checkout@v4",
    "    - uses: github/codeql-action/init@v3",
    "      with:",
    "        languages: javascript",
    "    - uses: github/codeql-action/analyze@v3",
])
SECURITY_WORKFLOW = (".github/workflows/security.yml", "secure", "Low", [
    "name: Security Checks",
    "on:",
    "  pull_request:",
    '    branches: [ "main" ]',
    "jobs:",
    "  audit:",
    "    runs-on: ubuntu-latest",
    "    steps:",
    "    - uses: actions/checkout@v4",
    "    - uses: actions/setup-node@v4",
    "      with:",
    "        node-version: 18",
    "    - name: Install",
    "      run: npm ci",
    "    - name: Audit High Severity",
    "      run: npm audit --audit-level=high || true",
])
# hunk header line counts as published for each file
HUNK_LINES = {DEPENDABOT[0]: 9, CODEQL[0]: 17, SECURITY_WORKFLOW[0]: 18}


def new_file_patch(file: str, lines: list[str]) -> str:
    body = [f"diff --git a/{file} b/{file}", "new file mode 100644", "--- /dev/null", f"+++ b/{file}",
            f"@@ -0,0 +1,{HUNK_LINES.get(file, len(lines))} @@"] + [f"+{x}" for x in lines] + [""]
    return "\n".join(body)


def remediation_suggestions(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """TXT-08: per scan, a Dependabot config unless a missing-policy title
    already mentions dependabot, a CodeQL workflow unless one mentions codeql,
    and always a security-audit workflow."""
    pol = findings.filter(F.col("kind") == "missing_policy")
    t = F.lower(F.coalesce("title", F.lit("")))
    flags = pol.groupBy("scan_id").agg(F.max(t.contains("dependabot").cast("int")).alias("dep"),
                                       F.max(t.contains("codeql").cast("int")).alias("cq"))
    s = scans.select("scan_id").distinct().join(flags, "scan_id", "left").fillna(0)

    def item(spec, cond):
        file, cat, sev, lines = spec
        return F.when(cond, F.struct(F.lit(file).alias("file"), F.lit(new_file_patch(file, lines)).alias("patch"),
                                     F.lit(cat).alias("category"), F.lit(sev).alias("severity")))
    arr = F.array_compact(F.array(item(DEPENDABOT, F.col("dep") == 0), item(CODEQL, F.col("cq") == 0),
                                  item(SECURITY_WORKFLOW, F.lit(True))))
    return s.select("scan_id", F.explode(arr).alias("s")).select("scan_id", "s.*")
