"""Text operators (TXT-*): search, snippets, redaction, suggestion hygiene,
unified diffs.

Everything that looks at one document stays inside that document's row
(array higher-order functions over its tokens / lines), so a search or a
redaction never shuffles text; only per-scan rankings shuffle, and those are
top-k window limits.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions.text import tokenize
from codelens.operators.ordered import row_index, running_sum
from codelens.operators.topk import top_k

# FIXED VALUES: redaction patterns, applied in this order (TXT-05)
REDACT_PATTERNS = [
    r"ghp_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"(?i)Bearer\s+[A-Za-z0-9\-_.]+",
    r"""(?i)(password|secret|token)\s*[:=]\s*[^\s"']+""",
    r"AWS_[A-Z_]+=\S+",
]
# Quoted values (``token = "abc"``) are missed by the list above; this form
# is appended by default (both lists are parameters).
REDACT_QUOTED = r"""(?i)(password|secret|token)\s*[:=]\s*["'][^"'\s]+["']"""
REDACTED = "[REDACTED]"

# FIXED VALUES: unsafe suggestion text (TXT-06)
UNSAFE_PATTERNS = [r"(?i)(^|[^A-Za-z0-9_])exfiltrate([^A-Za-z0-9_]|$)", r"(?i)(^|[^A-Za-z0-9_])curl\s+http",
                   r"(?i)rm\s+-rf", r"(?i)shutdown"]


def query_tokens(query: str) -> list[str]:
    """Python twin of ``tokenize`` for the (driver-side, tiny) query string."""
    import re
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9_\-\s]", " ", (query or "").lower())) if len(t) > 1]


def score_text(text: Column, query: str) -> Column:
    """TXT-02 score: sum over query tokens (repeats count again) of the
    token's frequency in the text.  One pass over the text's tokens with a
    literal token -> multiplicity map (a higher-order function's input is not
    shared between calls, so one fold beats one filter per query token)."""
    qc = Counter(query_tokens(query))
    if not qc:
        return F.lit(0).cast("long")
    weights = F.create_map(*[x for q, m in qc.items() for x in (F.lit(q), F.lit(m).cast("long"))])
    return F.aggregate(tokenize(text), F.lit(0).cast("long"),
                       lambda acc, t: acc + F.coalesce(weights[t], F.lit(0).cast("long")))


def snippet(text: Column, query: str, context: int = 2) -> Column:
    """TXT-03: first line containing any query token (substring, lower-case)
    with ``context`` lines around it: struct(start_line, end_line, match_line,
    snippet); NULL when no line matches."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    qs = list(dict.fromkeys(query_tokens(query)))
    if not qs:
        return F.lit(None).cast("struct<start_line:int,end_line:int,match_line:int,snippet:string>")
    hits = F.transform(lines, lambda ln: F.exists(F.array(*[F.lit(q) for q in qs]),
                                                  lambda q: F.lower(ln).contains(q)))
    i = F.array_position(hits, True).cast("int")  # 1-based, 0 when absent
    start = F.greatest(F.lit(1), i - context)
    end = F.least(F.size(lines), i + context)
    return F.when(i > 0, F.struct(start.alias("start_line"), end.alias("end_line"), i.alias("match_line"),
                                  F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("snippet")))


def search_files(files: DataFrame, query: str, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """TXT-02 + TXT-03 + TOP-04: files with score > 0, top k per scan by
    score (ties by path), with a snippet.

    The snippet (a few lines) is computed map-side for scoring files only, so
    document text never enters the shuffle of the per-scan top-k."""
    score = score_text(F.col("content"), query)
    s = files.select("scan_id", "path", score.alias("score"), "content")
    s = s.select("scan_id", "path", "score",
                 F.when(F.col("score") > 0, snippet(F.col("content"), query)).alias("sn"))
    # rank first, drop zero scores after: ranks of positive rows are the same
    # either way, and a filter on ``score`` placed before the window would be
    # pushed below the projection and tokenize every text twice.
    top = top_k(s, k, [F.col("score").desc(), F.col("path").asc()], by=by or ["scan_id"]).filter(F.col("score") > 0)
    return top.select("scan_id", "path", "score", "rank", F.col("sn.match_line").alias("match_line"),
                      F.col("sn.start_line").alias("start_line"), F.col("sn.end_line").alias("end_line"),
                      F.col("sn.snippet").alias("snippet"))


def search_logs(logs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """TXT-04: log lines with score > 0, top k per scan (ties by line number)."""
    s = logs.select("scan_id", "line_number", "msg", score_text(F.col("msg"), query).alias("score"))
    return top_k(s, k, [F.col("score").desc(), F.col("line_number").asc()], by=["scan_id"]).filter(F.col("score") > 0)


# lower-case literals of which every match of the pattern at the same index
# contains at least one (cheap probe before the regex runs)
REDACT_PROBES = [["ghp_"], ["sk-"], ["bearer"], ["password", "secret", "token"], ["aws_"]]
REDACT_QUOTED_PROBE = ["password", "secret", "token"]


def redact(df: DataFrame, col: str, patterns: list[str] | None = None, quoted: bool = True) -> DataFrame:
    """TXT-05: replace matches of each pattern in order with ``[REDACTED]``;
    ``redactions`` counts the replacements (each pattern counted on the text
    left by the previous ones).

    Each stage is its own projected column, so a stage's text is computed
    once; for the built-in patterns a substring probe skips the regex on texts
    that cannot match."""
    if patterns is None:
        pats = list(zip(REDACT_PATTERNS, REDACT_PROBES))
        if quoted:
            pats.append((REDACT_QUOTED, REDACT_QUOTED_PROBE))
    else:
        pats = [(p, None) for p in patterns]
    out = df.withColumn("_t0", F.coalesce(F.col(col).cast("string"), F.lit(""))).withColumn("redactions", F.lit(0).cast("long"))
    for i, (p, probe) in enumerate(pats):
        t = F.col(f"_t{i}")
        hit = F.lit(True)
        if probe:
            low = F.lower(t)
            hit = F.lit(False)
            for lit in probe:
                hit = hit | low.contains(lit)
        out = out.withColumn("_hit", hit).select(
            "*", F.when(F.col("_hit"), F.regexp_count(t, F.lit(p))).otherwise(F.lit(0)).cast("long").alias("_n"),
            F.when(F.col("_hit"), F.regexp_replace(t, p, REDACTED)).otherwise(t).alias(f"_t{i + 1}"))
        out = out.withColumn("redactions", F.col("redactions") + F.col("_n")).drop("_n", "_hit", f"_t{i}")
    return out.withColumnRenamed(f"_t{len(pats)}", "redacted")


def sanitize_suggestions(s: DataFrame) -> DataFrame:
    """TXT-06: drop suggestions whose (400-char) description is unsafe;
    truncate description 400 / patch 2000 / hint 300; severity outside
    Low/Medium/High -> Medium; unknown category -> modernize; missing file ->
    README.md; missing id -> deterministic md5 of the row's text."""
    cols = s.columns

    def c(name, default=""):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in cols else F.lit(default)
    desc = F.substring(c("description"), 1, 400)
    unsafe = F.lit(False)
    for p in UNSAFE_PATTERNS:
        unsafe = unsafe | desc.rlike(p)
    title = c("title")
    cat = F.coalesce(F.nullif(c("category"), F.lit("")), F.lit("modernize"))
    out = s.filter(~unsafe).select(
        *[F.col(x) for x in ("scan_id", "ord") if x in cols],
        F.coalesce(F.nullif(c("id"), F.lit("")), F.md5(F.concat_ws("\u0001", title, desc, c("file")))).alias("id"),
        title.alias("title"), desc.alias("description"),
        F.when(c("severity").isin("Low", "Medium", "High"), c("severity")).otherwise("Medium").alias("severity"),
        F.when(cat.isin("modernize", "secure", "performance", "cleanup"), cat).otherwise("modernize").alias("category"),
        F.coalesce(F.nullif(c("file"), F.lit("")), F.lit("README.md")).alias("file"),
        F.substring(c("patch"), 1, 2000).alias("patch"), F.substring(c("hint"), 1, 300).alias("hint"))
    return out


# FIXED VALUES: rule-based suggestions (TXT-07), in rule order:
# (rule key, title, description, severity, category, file, patch, hint)
GENERATED_SUGGESTIONS = [
    ("xhr", "Migrate XHR to fetch",
     "Replace legacy XMLHttpRequest calls with the modern fetch API for simpler code and better streaming support.",
     "Medium", "modernize", "src/index.js",
     "--- a/src/index.js\n+++ b/src/index.js\n@@\n-const xhr = new XMLHttpRequest();\n+xhr = undefined;\n+const res = await fetch(\"/api\");",
     "Use AbortController for cancellable requests."),
    ("polyfill", "Remove Promise polyfill",
     "Drop core-js Promise polyfill since async/await is supported in target browsers.",
     "Low", "cleanup", "package.json",
     "--- a/package.json\n+++ b/package.json\n@@\n-  \"dependencies\": { \"core-js\": \"^3\" }\n+  \"dependencies\": {}",
     "Confirm baseline coverage before removal."),
    ("abort", "Enable AbortController",
     "Add AbortController to cancel in-flight fetch requests and avoid memory leaks.",
     "Medium", "performance", "src/api/client.js",
     "--- a/src/api/client.js\n+++ b/src/api/client.js\n@@\n+const controller = new AbortController();\n+await fetch(url, { signal: controller.signal });",
     "Wire cancellation into retry logic."),
    ("csp", "Add CSP via helmet",
     "Introduce Content Security Policy to mitigate XSS and data injection attacks.",
     "High", "secure", "server.js",
     "--- a/server.js\n+++ b/server.js\n@@\n+const helmet = require(\"helmet\");\n+app.use(helmet.contentSecurityPolicy({ directives: { defaultSrc: [\"self\"] } }));",
     "Tailor CSP for required domains."),
    ("next_config", "Add next.config.js",
     "Create next.config.js with performance-focused flags (swcMinify, reactStrictMode).",
     "Low", "performance", "next.config.js",
     "--- /dev/null\n+++ b/next.config.js\n@@\n+module.exports = { swcMinify: true, reactStrictMode: true };",
     "Consider image optimization settings."),
]


def generate_suggestions(flags: DataFrame) -> DataFrame:
    """TXT-07: rule-based suggestions from per-scan flags (``has_xhr``,
    ``has_fetch``, ``has_abort``, ``has_promise_polyfill``, ``has_async_await``,
    ``policies``, ``has_helmet_cfg``, ``has_next``, ``has_next_cfg``)."""
    g = F.col
    conds = {
        "xhr": (g("has_xhr") == 1) & (g("has_fetch") == 0),
        "polyfill": (g("has_promise_polyfill") == 1) & (g("has_async_await") == 1),
        "abort": (g("has_fetch") == 1) & (g("has_abort") == 0),
        "csp": (g("policies") > 0) & (g("has_helmet_cfg") == 0),
        "next_config": (g("has_next") == 1) & (g("has_next_cfg") == 0),
    }
    fields = ["title", "description", "severity", "category", "file", "patch", "hint"]
    arr = F.array(*[F.when(conds[key], F.struct(F.lit(i + 1).alias("ord"),
                                                *[F.lit(v).alias(f) for f, v in zip(fields, rest)]))
                    for i, (key, *rest) in enumerate(GENERATED_SUGGESTIONS)])
    rows = flags.select("scan_id", F.explode(F.array_compact(arr)).alias("s")).select("scan_id", "s.*")
    return sanitize_suggestions(rows.withColumn("id", F.lit(None).cast("string")))


def rationale(router_allow: DataFrame, reasons: DataFrame) -> DataFrame:
    """TXT-11: per scan the two fixed lines, the router line (allowed
    frameworks / languages) and the first four router reasons by ``ord``."""
    allow = router_allow.filter(F.col("allowed")).groupBy("scan_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("grp") == "frameworks", F.col("name")))), ", ").alias("fw"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("grp") == "languages", F.col("name")))), ", ").alias("lang"))
    fixed = F.array(
        F.struct(F.lit("features").alias("label"), F.lit("Suggestions derived from detected features and configs").alias("detail")),
        F.struct(F.lit("guardrails").alias("label"), F.lit("Secrets redacted; unsafe actions filtered; rate limited").alias("detail")),
        F.struct(F.lit("router-hints").alias("label"),
                 F.concat(F.lit("Allowed frameworks: "), F.coalesce(F.nullif("fw", F.lit("")), F.lit("none")),
                          F.lit("; allowed languages: "), F.coalesce(F.nullif("lang", F.lit("")), F.lit("none"))).alias("detail")))
    top = top_k(reasons, 4, [F.col("ord"), F.col("label"), F.col("detail")], by=["scan_id"], rank_col="rank").groupBy("scan_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "label", "detail"))).alias("r"))
    j = allow.join(top, "scan_id", "left")
    extra = F.transform(F.coalesce(F.col("r"), F.array()), lambda x: F.struct(x["label"].alias("label"), x["detail"].alias("detail")))
    return j.select("scan_id", F.concat(fixed, extra).alias("rationale"))


# -- unified diffs (TXT-09, TXT-10) -------------------------------------------------

def diff_block(file: Column, original: Column, modified: Column, patch: Column, idx: Column) -> Column:
    """One suggestion's part of the unified diff: the trimmed patch as is,
    else a simplified ``--- a/ +++ b/ @@`` block of ``-``/``+`` lines; every
    block ends with an empty line."""
    p = F.regexp_replace(F.coalesce(patch, F.lit("")), r"^\s+|\s+$", "")
    f = F.coalesce(F.nullif(file, F.lit("")), F.concat(F.lit("file-"), idx.cast("string")))
    minus = F.transform(F.split(F.coalesce(original, F.lit("")), "\n"), lambda x: F.concat(F.lit("-"), x))
    plus = F.transform(F.split(F.coalesce(modified, F.lit("")), "\n"), lambda x: F.concat(F.lit("+"), x))
    built = F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), f), F.concat(F.lit("+++ b/"), f), F.lit("@@")),
                                  minus, plus, F.array(F.lit(""))), "\n")
    return F.when(F.length(p) > 0, F.concat(p, F.lit("\n"))).otherwise(built)


def build_diff(suggestions: DataFrame, by: str = "scan_id", ord_col: str = "ord") -> DataFrame:
    """TXT-10: one unified diff per scan, suggestion blocks in ``ord`` order.
    Blocks are ordered by sorting (ord, block) structs per scan — the collected
    list is one scan's patch, which is what the operator returns."""
    cols = suggestions.columns

    def c(n):
        return F.col(n) if n in cols else F.lit(None).cast("string")
    idx = F.row_number().over(Window.partitionBy(by).orderBy(ord_col)) - 1
    b = suggestions.withColumn("_idx", idx).select(
        by, F.col(ord_col).alias("_o"),
        diff_block(c("file"), c("original"), c("modified"), c("patch"), F.col("_idx")).alias("_b"))
    return b.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_b"))),
                                                      lambda x: x["_b"]), "\n").alias("diff"))


def diff_parts(suggestions: DataFrame, by: str = "scan_id", ord_col: str = "ord", part_bytes: int = 8 << 20) -> DataFrame:
    """TXT-10 in parts ``(by, at, text)``: a scan's diff is its parts in order of ``at``,
    joined by a line feed, and ``at`` is the byte where a part starts in it.

    Numbers and byte offsets of the blocks are running sums over range partitions,
    so no task holds a scan: a part holds the blocks that start within its
    ``part_bytes``.  Equal ``ord`` values are ordered by the suggestion's own columns."""
    ties = [n for n in ("file", "original", "modified", "patch") if n in suggestions.columns]

    def c(n):
        return F.col(n) if n in ties else F.lit(None).cast("string")
    numbered = row_index(suggestions.select(by, ord_col, *ties), [by], [ord_col, *ties], "_row")
    blocks = numbered.select(by, "_row", diff_block(c("file"), c("original"), c("modified"), c("patch"), F.col("_row") - 1).alias("_b"))
    size = (F.octet_length("_b") + 1).cast("long")
    placed = running_sum(blocks, [by], ["_row"], size, "_end").withColumn("_at", F.col("_end") - size)
    return placed.groupBy(by, F.floor(F.col("_at") / part_bytes).alias("_part")).agg(
        F.min("_at").cast("long").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_b"))), lambda x: x["_b"]), "\n").alias("text")).drop("_part")


def parse_diffs(df: DataFrame, col: str, key: str = "doc_id") -> DataFrame:
    """TXT-09: unified diff text -> ``(key, block, path, original, modified)``
    per file block.

    Everything happens inside the document's row (no shuffle): the positions
    of the ``--- `` header lines split the line array into blocks; a block's
    path is its ``+++ b/...`` path, else the ``--- [a/]...`` path; ``-`` and
    ``+`` lines (other than the headers) are joined in line order.  Blocks
    without a path are dropped."""
    lines = F.split(F.coalesce(F.col(col), F.lit("")), r"\r?\n")
    d = df.select(key, lines.alias("_l"))
    hdr = F.filter(F.transform("_l", lambda ln, i: F.when(ln.startswith("--- "), i + 1)), lambda x: x.isNotNull())
    d = d.withColumn("_h", hdr)
    nxt = lambda k: F.coalesce(F.try_element_at(F.col("_h"), (k + 2).cast("int")), F.size("_l") + 1)
    blocks = F.transform("_h", lambda h, k: F.struct((k + 1).alias("block"),
                                                     F.slice("_l", h, nxt(k) - h).alias("lines")))
    b = d.select(key, F.explode(blocks).alias("b")).select(key, "b.block", F.col("b.lines").alias("ls"))
    first = F.try_element_at(F.col("ls"), F.lit(1))
    a_path = F.nullif(F.regexp_extract(first, r"^---\s+(?:a/)?(.+?)\s*$", 1), F.lit(""))
    plus_hdr = F.filter("ls", lambda x: x.startswith("+++ "))
    b_path = F.nullif(F.regexp_extract(F.try_element_at(plus_hdr, F.lit(1)), r"^\+\+\+\s+b/(.+?)\s*$", 1), F.lit(""))
    body = F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0)))
    orig = F.transform(F.filter(body, lambda x: x.startswith("-")), lambda x: F.substring(x, 2, 1 << 30))
    mod = F.transform(F.filter(body, lambda x: x.startswith("+") & ~x.startswith("+++ ")),
                      lambda x: F.substring(x, 2, 1 << 30))
    return b.select(key, "block", F.coalesce(b_path, a_path).alias("path"), F.array_join(orig, "\n").alias("original"),
                    F.array_join(mod, "\n").alias("modified")).filter(F.col("path").isNotNull())
