"""Queries: text operators (TXT-*) over whole documents, logs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import dims
from codelens.functions.text import tokenize
from codelens.operators import score as S
from codelens.operators import text as X
from codelens.plans import bindings as V
from codelens.plans.catalog import register

TOKENS_SQL = ("list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9_\\-\\s]', ' ', 'g')), "
              "'\\s+'), lambda t: length(t) > 1)")

TXT01_SQL = f"""
SELECT doc_id, CAST(len({TOKENS_SQL.format(c='text')}) AS INTEGER) AS n_tokens FROM documents
"""


@register("TXT-01", TXT01_SQL)
def q_txt01(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tokenize(F.col("text"))).alias("n_tokens"))


QUERY = "license token token"
FILES = f"({V.V_FILES_SQL})"


def _score_sql(col: str) -> str:
    return (f"(len(list_filter({TOKENS_SQL.format(c=col)}, lambda t: t = 'license')) + "
            f"2 * len(list_filter({TOKENS_SQL.format(c=col)}, lambda t: t = 'token')))")


TXT02_SQL = f"""
WITH s AS (SELECT scan_id, path, content, CAST({_score_sql('content')} AS BIGINT) AS score FROM {FILES}),
t AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, path) AS rank FROM s WHERE score > 0),
l AS (SELECT *, string_split_regex(coalesce(content, ''), '\\r?\\n') AS lines FROM t WHERE rank <= 10),
p AS (SELECT *, CAST(coalesce(list_position(list_transform(lines, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'token')), true), 0) AS INTEGER) AS i FROM l)
SELECT scan_id, path, score, rank,
       CASE WHEN i > 0 THEN i END AS match_line,
       CASE WHEN i > 0 THEN CAST(greatest(1, i - 2) AS INTEGER) END AS start_line,
       CASE WHEN i > 0 THEN CAST(least(len(lines), i + 2) AS INTEGER) END AS end_line,
       CASE WHEN i > 0 THEN array_to_string(lines[greatest(1, i - 2):least(len(lines), i + 2)], chr(10)) END AS snippet
FROM p
"""


@register("TXT-02", TXT02_SQL)
def q_txt02(spark, sf_dir):
    r = X.search_files(V.v_files(spark, sf_dir), QUERY, 10)
    return r.withColumn("rank", F.col("rank").cast("long"))


TXT03_SQL = f"""
WITH l AS (SELECT scan_id, path, string_split_regex(coalesce(content, ''), '\\r?\\n') AS lines FROM {FILES}),
p AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'token')), true), 0) AS i FROM l)
SELECT scan_id, path, CAST(i AS INTEGER) AS match_line, CAST(greatest(1, i - 1) AS INTEGER) AS start_line,
       CAST(least(len(lines), i + 1) AS INTEGER) AS end_line, array_to_string(lines[greatest(1, i - 1):least(len(lines), i + 1)], chr(10)) AS snippet
FROM p WHERE i > 0
"""


@register("TXT-03", TXT03_SQL)
def q_txt03(spark, sf_dir):
    """Snippet (one line of context) of every file with a hit, ranked or not."""
    sn = X.snippet(F.col("content"), QUERY, context=1)
    r = V.v_files(spark, sf_dir).select("scan_id", "path", sn.alias("sn")).filter(F.col("sn").isNotNull())
    return r.select("scan_id", "path", "sn.match_line", "sn.start_line", "sn.end_line", "sn.snippet")


TOP04_SQL = f"""
SELECT scan_id, path, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, path) AS rank FROM (
    SELECT scan_id, path, CAST(len(list_filter({TOKENS_SQL.format(c='content')}, lambda t: t IN ('the', 'der', 'que', 'une'))) AS BIGINT) AS score
    FROM {FILES}) WHERE score > 0) WHERE rank <= 3
"""


@register("TOP-04", TOP04_SQL)
def q_top04(spark, sf_dir):
    """The three best hits of each scan for words that most files have: ranks decide."""
    r = X.search_files(V.v_files(spark, sf_dir), "The der, que une!", 3)
    return r.select("scan_id", "path", "score", F.col("rank").cast("long").alias("rank"))


LOGQ = "the der"
TXT04_SQL = f"""
SELECT scan_id, line_number, msg, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, line_number) AS rank FROM (
    SELECT scan_id, line_number, msg,
      CAST(len(list_filter({TOKENS_SQL.format(c='msg')}, lambda t: t = 'the')) + len(list_filter({TOKENS_SQL.format(c='msg')}, lambda t: t = 'der')) AS BIGINT) AS score
    FROM ({V.V_LOGS_SQL})) WHERE score > 0) WHERE rank <= 10
"""


@register("TXT-04", TXT04_SQL)
def q_txt04(spark, sf_dir):
    r = X.search_logs(V.v_logs(spark, sf_dir), LOGQ, 10)
    return r.select("scan_id", "line_number", "msg", "score", F.col("rank").cast("long").alias("rank"))


def _redact_sql() -> str:
    pats = X.REDACT_PATTERNS + [X.REDACT_QUOTED]
    text = "coalesce(text, '')"
    count_terms = []
    for p in pats:
        ps = p.replace("'", "''")
        count_terms.append(f"len(regexp_extract_all({text}, '{ps}'))")
        text = f"regexp_replace({text}, '{ps}', '[REDACTED]', 'g')"
    return f"SELECT doc_id, CAST({' + '.join(count_terms)} AS BIGINT) AS redactions, md5({text}) AS redacted_md5 FROM documents"


@register("TXT-05", _redact_sql())
def q_txt05(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    r = X.redact(d, "text")
    return r.select("doc_id", "redactions", F.md5("redacted").alias("redacted_md5"))


TXT06_SQL = f"""
WITH s AS (SELECT v.*, substr(coalesce(d.text, ''), 1, 400) AS description
           FROM ({V.V_SUGGESTIONS_SQL}) v JOIN documents d ON v.ord = d.doc_id)
SELECT scan_id, ord, coalesce(nullif(id, ''), md5(concat_ws(chr(1), coalesce(title, ''), description, coalesce(file, '')))) AS id,
       coalesce(title, '') AS title, md5(description) AS description_md5,
       CASE WHEN severity IN ('Low', 'Medium', 'High') THEN severity ELSE 'Medium' END AS severity,
       CASE WHEN coalesce(nullif(category, ''), 'modernize') IN ('modernize', 'secure', 'performance', 'cleanup')
            THEN coalesce(nullif(category, ''), 'modernize') ELSE 'modernize' END AS category,
       coalesce(nullif(file, ''), 'README.md') AS file
FROM s
WHERE NOT (regexp_matches(description, '(?i)(^|[^A-Za-z0-9_])exfiltrate([^A-Za-z0-9_]|$)')
        OR regexp_matches(description, '(?i)(^|[^A-Za-z0-9_])curl\\s+http')
        OR regexp_matches(description, '(?i)rm\\s+-rf') OR regexp_matches(description, '(?i)shutdown'))
"""


@register("TXT-06", TXT06_SQL)
def q_txt06(spark, sf_dir):
    s = V.v_suggestions(spark, sf_dir)
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("description"))
    r = X.sanitize_suggestions(s.join(d, "ord"))
    return r.select("scan_id", "ord", "id", "title", F.md5("description").alias("description_md5"), "severity",
                    "category", "file")


def txt07_flags(spark, sf_dir):
    f = V.v_features(spark, sf_dir)
    flags = S.scan_flags(f, V.v_configs(spark, sf_dir), V.v_findings(spark, sf_dir),
                         dims.feature_dim(spark))
    extra = f.groupBy("scan_id").agg(
        F.max((F.col("feature") == "async-await").cast("int")).alias("has_async_await"))
    fw = V.v_frameworks(spark, sf_dir).groupBy("scan_id").agg(F.max((F.col("name") == "Next.js").cast("int")).alias("has_next"))
    cfg = V.v_configs(spark, sf_dir).groupBy("scan_id").agg(
        F.max(F.col("name").isin("next.config.js", "next.config.mjs").cast("int")).alias("has_next_cfg"))
    return flags.join(extra, "scan_id", "left").join(fw, "scan_id", "left").join(cfg, "scan_id", "left").fillna(0)


GEN = X.GENERATED_SUGGESTIONS
TXT07_SQL = f"""
WITH f AS (SELECT scan_id, max(CASE WHEN feature = 'XMLHttpRequest' THEN 1 ELSE 0 END) AS xhr,
             max(CASE WHEN feature = 'fetch' THEN 1 ELSE 0 END) AS has_fetch,
             max(CASE WHEN feature = 'AbortController' THEN 1 ELSE 0 END) AS abort,
             max(CASE WHEN feature = 'core-js/features/promise' THEN 1 ELSE 0 END) AS poly,
             max(CASE WHEN feature = 'async-await' THEN 1 ELSE 0 END) AS aa
           FROM ({V.V_FEATURES_SQL}) GROUP BY scan_id),
p AS (SELECT scan_id, count(*) FILTER (WHERE kind = 'missing_policy') AS policies FROM ({V.V_FINDINGS_SQL}) GROUP BY scan_id),
g AS (SELECT coalesce(f.scan_id, p.scan_id) AS scan_id, coalesce(xhr, 0) AS xhr, coalesce(has_fetch, 0) AS has_fetch,
             coalesce(abort, 0) AS abort, coalesce(poly, 0) AS poly, coalesce(aa, 0) AS aa, coalesce(policies, 0) AS policies
      FROM f FULL JOIN p ON f.scan_id = p.scan_id),
fw AS (SELECT scan_id FROM ({V.V_FRAMEWORKS_SQL}) WHERE name = 'Next.js'), cf AS ({V.V_CONFIGS_SQL})
SELECT scan_id, title, severity, category, file FROM (
  SELECT scan_id, '{GEN[0][1]}' AS title, '{GEN[0][3]}' AS severity, '{GEN[0][4]}' AS category, '{GEN[0][5]}' AS file FROM g WHERE xhr = 1 AND has_fetch = 0
  UNION ALL SELECT scan_id, '{GEN[1][1]}', '{GEN[1][3]}', '{GEN[1][4]}', '{GEN[1][5]}' FROM g WHERE poly = 1 AND aa = 1
  UNION ALL SELECT scan_id, '{GEN[2][1]}', '{GEN[2][3]}', '{GEN[2][4]}', '{GEN[2][5]}' FROM g WHERE has_fetch = 1 AND abort = 0
  UNION ALL SELECT scan_id, '{GEN[3][1]}', '{GEN[3][3]}', '{GEN[3][4]}', '{GEN[3][5]}' FROM g WHERE policies > 0
    AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.scan_id = g.scan_id AND name = 'helmet.config.js')
  UNION ALL SELECT scan_id, '{GEN[4][1]}', '{GEN[4][3]}', '{GEN[4][4]}', '{GEN[4][5]}' FROM g
  WHERE EXISTS (SELECT 1 FROM fw WHERE fw.scan_id = g.scan_id)
    AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.scan_id = g.scan_id AND name IN ('next.config.js', 'next.config.mjs')))
"""


@register("TXT-07", TXT07_SQL)
def q_txt07(spark, sf_dir):
    return X.generate_suggestions(txt07_flags(spark, sf_dir)).select("scan_id", "title", "severity", "category", "file")


def conv_diff(spark, sf_dir):
    return X.build_diff(V.v_conv_suggestions(spark, sf_dir))


BLOCK_SQL = ("'--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@' || chr(10) || "
             "array_to_string(list_transform(string_split(coalesce(original, ''), chr(10)), lambda x: '-' || x), chr(10)) || chr(10) || "
             "array_to_string(list_transform(string_split(coalesce(modified, ''), chr(10)), lambda x: '+' || x), chr(10)) || chr(10)")
CONV_SUGG_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS scan_id, turn AS ord,
       'conv/' || CAST(conv_id AS VARCHAR) || '/turn' || CAST(turn AS VARCHAR) || '.txt' AS file,
       text AS original, replace(text, 'the', 'THE') AS modified
FROM conversations
"""
TXT10_SQL = f"""
SELECT scan_id, md5(string_agg({BLOCK_SQL}, chr(10) ORDER BY ord)) AS diff_md5,
       CAST(sum(length({BLOCK_SQL})) + count(*) - 1 AS BIGINT) AS n_chars
FROM ({CONV_SUGG_SQL}) GROUP BY scan_id
"""


@register("TXT-10", TXT10_SQL)
def q_txt10(spark, sf_dir):
    d = conv_diff(spark, sf_dir)
    return d.select("scan_id", F.md5("diff").alias("diff_md5"), F.length("diff").cast("long").alias("n_chars"))


TXT10_PARTS_SQL = f"""
WITH b AS (SELECT scan_id, ord, {BLOCK_SQL} AS block FROM ({CONV_SUGG_SQL})),
p AS (SELECT *, sum(strlen(block) + 1) OVER (PARTITION BY scan_id ORDER BY ord) - strlen(block) - 1 AS pos FROM b)
SELECT scan_id, CAST(min(pos) AS BIGINT) AS "at", md5(string_agg(block, chr(10) ORDER BY ord)) AS text_md5
FROM p GROUP BY scan_id, pos // 1024
"""


@register("TXT-10-parts", TXT10_PARTS_SQL)
def q_txt10_parts(spark, sf_dir):
    """The diffs of TXT-10 in parts of about 1 KB, without a task that holds a scan's diff."""
    parts = X.diff_parts(V.v_conv_suggestions(spark, sf_dir), part_bytes=1024)
    return parts.select("scan_id", "at", F.md5("text").alias("text_md5"))


TXT09_SQL = f"""
SELECT scan_id, file AS path, md5(coalesce(original, '')) AS original_md5, md5(coalesce(modified, '')) AS modified_md5
FROM ({CONV_SUGG_SQL})
"""


@register("TXT-09", TXT09_SQL)
def q_txt09(spark, sf_dir):
    p = X.parse_diffs(conv_diff(spark, sf_dir), "diff", key="scan_id")
    return p.select("scan_id", "path", F.md5("original").alias("original_md5"), F.md5("modified").alias("modified_md5"))
