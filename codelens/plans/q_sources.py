"""Queries: sources (SRC-*) and sinks (SNK-*).

Sources that read files (corpus listing, changed-path text) first write the
data Spark derives from the driver tables into the session's shared
checkpoint folder (``spark.checkpoint.dir``), then read it back through the
real source; tool-output sources parse JSON documents that Spark builds from
the driver tables.  The oracle computes the expected rows from the tables
directly."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelens.operators import score as S
from codelens.operators import topk as T
from codelens.plans import bindings as V
from codelens.plans.catalog import ORACLE, register
from codelens.session import ensure_checkpoint_dir
from codelens.sources import corpus as C
from codelens.sources import manifests as M
from codelens.sources import sinks as K
from codelens.sources import tools as TL

FILES = f"({V.V_FILES_SQL})"
FIND = f"({V.V_FINDINGS_SQL})"
SCANS = f"({V.V_SCANS_SQL})"


def scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder: parallel runs do not meet."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/codelens-sources/{uuid.uuid4().hex}/{name}"


SRC01_SQL = """
SELECT source AS scan_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS newlines
FROM documents GROUP BY source
"""


@register("SRC-01", SRC01_SQL)
def q_src01(spark, sf_dir):
    root = scratch(spark, "corpus")
    d = V.table(spark, sf_dir, "documents").select("source", "text", (F.col("doc_id") % 4 == 0).alias("hidden"))
    # every fourth document lies below a hidden folder that has no visible file
    d.filter(~F.col("hidden")).drop("hidden").write.partitionBy("source").text(root)
    d.filter("hidden").drop("hidden").write.partitionBy("source").text(root + "/.notes")
    files = C.read_corpus(spark, root, "corpus").filter(~F.col("basename").rlike(r"^_SUCCESS$|\.crc$"))  # the writer's own
    nl = F.length("content") - F.length(F.regexp_replace("content", "\n", ""))
    return files.select(F.regexp_extract("path", r"(?:^|/)source=([^/]+)/", 1).alias("scan_id"), "size", nl.alias("nl")).groupBy(
        "scan_id").agg(F.sum("size").cast("long").alias("bytes"), F.sum("nl").cast("long").alias("newlines"))


SRC02_SQL = f"SELECT scan_id, path FROM {FILES} WHERE ext IN ('.js', '.css')"


@register("SRC-02", SRC02_SQL)
def q_src02(spark, sf_dir):
    return C.by_extension(V.v_files(spark, sf_dir), [".JS", ".css"]).select("scan_id", "path")


SRC03_SQL = f"SELECT scan_id, path FROM {FILES} WHERE dir <> 'es'"


@register("SRC-03", SRC03_SQL)
def q_src03(spark, sf_dir):
    return C.prune_dirs(V.v_files(spark, sf_dir), ["es"]).select("scan_id", "path")


SRC04_SQL = f"SELECT scan_id, path FROM {FILES} WHERE NOT (contains(path, 'de/') OR contains(path, 'fr/1'))"


@register("SRC-04", SRC04_SQL)
def q_src04(spark, sf_dir):
    return C.exclude_paths(V.v_files(spark, sf_dir), " de/ ; fr/1,de/").select("scan_id", "path")


SRC07_SQL = f"SELECT scan_id, path, size FROM {FILES} WHERE size <= 10000"


@register("SRC-07", SRC07_SQL)
def q_src07(spark, sf_dir):
    return C.max_size(V.v_files(spark, sf_dir), 10000).select("scan_id", "path", "size")


def manifest_files(spark, sf_dir):
    """package.json documents built from the part table: one per (scan, brand)."""
    d = V.v_deps(spark, sf_dir)
    per = d.groupBy("scan_id", "package_dir", "dev", "name").agg(F.min(F.col("version").cast("int")).cast("string").alias("version"))
    pkg = per.groupBy("scan_id", "package_dir").agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("dev"), F.struct("name", "version")))).alias("dependencies"),
        F.map_from_entries(F.collect_list(F.when(F.col("dev"), F.struct("name", "version")))).alias("devDependencies"))
    return pkg.select("scan_id", F.concat(F.col("package_dir"), F.lit("/package.json")).alias("path"),
                      F.to_json(F.struct("dependencies", "devDependencies")).alias("content"))


SRC09_SQL = """
SELECT (['A', 'N', 'R'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS scan_id, p_brand AS package_dir, p_name AS name,
       CAST(min(p_size) AS VARCHAR) AS version, p_size % 2 = 0 AS dev
FROM part GROUP BY 1, 2, 3, 5
"""


@register("SRC-09", SRC09_SQL)
def q_src09(spark, sf_dir):
    return M.read_manifests(manifest_files(spark, sf_dir))


def semgrep_docs(spark, sf_dir):
    f = V.v_findings(spark, sf_dir).filter(F.col("source") == "semgrep")
    r = F.struct(F.col("title").alias("check_id"), F.col("file").alias("path"),
                 F.struct((F.col("ord") % 100).cast("int").alias("line")).alias("start"),
                 F.struct((F.col("ord") % 100 + 1).cast("int").alias("line")).alias("end"),
                 F.struct(F.col("severity").alias("severity"), F.col("description").alias("message")).alias("extra"))
    return f.groupBy("scan_id", "file").agg(F.to_json(F.struct(F.collect_list(r).alias("results"))).alias("json"))


SEMSEV = ("CASE WHEN lower(coalesce(severity, '')) LIKE '%error%' OR lower(coalesce(severity, '')) LIKE '%high%' "
          "OR lower(coalesce(severity, '')) LIKE '%critical%' THEN 'High' "
          "WHEN lower(coalesce(severity, '')) LIKE '%warning%' OR lower(coalesce(severity, '')) LIKE '%medium%' "
          "THEN 'Medium' ELSE 'Low' END")
SRC10_SQL = f"""
SELECT scan_id, title, {SEMSEV} AS severity, coalesce(file, '') AS file, description,
       CAST(ord % 100 AS INTEGER) AS range_start, CAST(ord % 100 + 1 AS INTEGER) AS range_end
FROM {FIND} WHERE source = 'semgrep'
"""


@register("SRC-10", SRC10_SQL)
def q_src10(spark, sf_dir):
    r = TL.read_semgrep(semgrep_docs(spark, sf_dir))
    return r.select("scan_id", "title", "severity", "file", "description",
                    F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end"))


def trufflehog_lines(spark, sf_dir):
    f = V.v_findings(spark, sf_dir).filter(F.col("source") == "trufflehog")
    m = F.col("ord") % 3
    obj = F.struct(
        F.when(m == 0, F.col("title")).alias("DetectorName"), F.when(m == 1, F.col("title")).alias("detector"),
        F.when(m == 2, F.col("title")).alias("rule"),
        F.when(m == 0, F.struct(F.struct(F.col("file").alias("filepath")).alias("Data"))).alias("SourceMetadata"),
        F.when(m == 1, F.col("file")).alias("path"), F.when(m == 2, F.col("file")).alias("File"),
        F.when(m == 0, F.col("ord") % 2 == 0).alias("Verified"), F.when(m != 0, F.col("ord") % 2 == 0).alias("verified"))
    js = f.select("scan_id", (F.col("ord") * 2).alias("ord"), F.to_json(obj).alias("value"))
    junk = f.select("scan_id", (F.col("ord") * 2 + 1).alias("ord"),
                    F.concat(F.lit("scanning "), F.col("description")).alias("value"))
    return js.unionByName(junk)


SRC11_SQL = f"""
SELECT scan_id, title, coalesce(file, '') AS file, ord % 2 = 0 AS verified FROM {FIND} WHERE source = 'trufflehog'
"""


@register("SRC-11", SRC11_SQL)
def q_src11(spark, sf_dir):
    return TL.read_trufflehog(trufflehog_lines(spark, sf_dir)).select("scan_id", "title", "file", "verified")


def outdated_docs(spark, sf_dir):
    d = V.v_deps(spark, sf_dir)
    per = d.groupBy("scan_id", "package_dir", "name").agg(
        F.min(F.col("version").cast("int")).cast("string").alias("current"),
        F.max(F.col("version").cast("int")).cast("string").alias("latest"))
    return per.groupBy("scan_id", "package_dir").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.struct("current", "latest"))))).alias("json")
    ).withColumn("dir_ord", F.regexp_extract("package_dir", r"(\d+)$", 1).cast("int"))


SRC12_SQL = """
WITH p AS (SELECT (['A', 'N', 'R'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS scan_id, p_brand, p_name AS name,
                  CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS dir_ord,
                  CAST(min(p_size) AS VARCHAR) AS current, CAST(max(p_size) AS VARCHAR) AS latest
           FROM part GROUP BY 1, 2, 3)
SELECT scan_id, name, arg_max(current, dir_ord) AS current, arg_max(latest, dir_ord) AS latest
FROM p GROUP BY scan_id, name
"""


@register("SRC-12", SRC12_SQL)
def q_src12(spark, sf_dir):
    return TL.read_outdated(outdated_docs(spark, sf_dir))


def audit_docs(spark, sf_dir):
    """npm-audit documents: one per scan and 200 event numbers."""
    f = V.v_findings(spark, sf_dir).filter(F.col("source") == "npm-audit")
    entry = F.struct(F.concat_ws("-", "title", F.col("ord").cast("string")).alias("name"), F.struct(
        "severity", F.col("file").alias("via"), F.concat(F.lit("<"), (F.col("ord") % 7).cast("string"), F.lit(".0.0")).alias("range"),
        (F.col("ord") % 2 == 0).cast("string").alias("fixAvailable")).alias("v"))
    docs = f.groupBy("scan_id", F.floor(F.col("ord") / 200).cast("long").alias("dir_ord")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("vulnerabilities"))
    return docs.select("scan_id", "dir_ord", F.to_json(F.struct("vulnerabilities")).alias("json"))


SRC12_AUDIT_SQL = f"""
SELECT scan_id, CAST(ord // 200 AS BIGINT) AS dir_ord, title || '-' || CAST(ord AS VARCHAR) AS name, severity,
       '<' || CAST(ord % 7 AS VARCHAR) || '.0.0' AS range, CASE WHEN ord % 2 = 0 THEN 'true' ELSE 'false' END AS fix
FROM {FIND} WHERE source = 'npm-audit'
"""


@register("SRC-12-audit", SRC12_AUDIT_SQL)
def q_src12_audit(spark, sf_dir):
    return TL.read_audit(audit_docs(spark, sf_dir))


SRC13_SQL = f"SELECT id, repo_url, created_at FROM {SCANS} WHERE status = 'done'"


@register("SRC-13", SRC13_SQL)
def q_src13(spark, sf_dir):
    s = V.v_scans(spark, sf_dir)
    return s.filter(F.col("status") == "done").select("id", "repo_url", "created_at")


SRC14_SQL = f"SELECT DISTINCT scan_id, path FROM ({V.V_CHANGED_SQL})"


@register("SRC-14", SRC14_SQL)
def q_src14(spark, sf_dir):
    root = scratch(spark, "changed")
    ch = V.v_changed(spark, sf_dir)
    # diff --name-only text with padding, Windows slashes and blank lines
    lines = ch.select("scan_id", F.concat(F.lit("  "), F.regexp_replace("path", "/", r"\\"), F.lit(" ")).alias("value"))
    blanks = ch.select("scan_id", F.lit("   ").alias("value"))
    lines.unionByName(blanks).write.partitionBy("scan_id").text(root)
    return C.read_changed_paths(spark, root, None)


# -- sinks ------------------------------------------------------------------------
SNK05_SQL = f"""
SELECT id, CASE WHEN status = 'queued' THEN 'processing' ELSE status END AS status,
       CASE WHEN status = 'queued' THEN 1.0 ELSE progress END AS progress
FROM {SCANS}
"""


@register("SNK-05", SNK05_SQL)
def q_snk05(spark, sf_dir):
    s = V.v_scans(spark, sf_dir).select("id", "status", "progress")
    upd = s.filter(F.col("status") == "queued").select("id", F.lit("processing").alias("status"),
                                                        F.lit(1.0).alias("progress"))
    return K.upsert(s, upd, "id", ts_col=None)


SNK06_SQL = f"SELECT id, status FROM {SCANS} WHERE status <> 'processing'"


@register("SNK-06", SNK06_SQL)
def q_snk06(spark, sf_dir):
    s = V.v_scans(spark, sf_dir).select("id", "status")
    return K.delete_scans(s, s.filter(F.col("status") == "processing").select("id"), "id")


@register("SNK-07", None)
def q_snk07(spark, sf_dir):
    files = V.v_files(spark, sf_dir)
    return K.scan_overview(S.repo_stats(files), S.feature_usage(V.v_features(spark, sf_dir)), T.largest_files(files, 10))


SRC16_SQL = f"""
WITH g AS (SELECT scan_id, path, content FROM ({V.V_CODE_SQL}) WHERE basename = 'go.mod'),
l AS (SELECT scan_id, path, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos,
             regexp_replace(unnest(string_split(content, chr(10))), '^\\s+|\\s+$', '', 'g') AS l FROM g),
m AS (SELECT *, regexp_matches(l, '^require\\s*\\(\\s*$') AS opener, regexp_matches(l, '^\\)') AS closer FROM l),
s AS (SELECT *, coalesce(last_value(CASE WHEN opener THEN 1 WHEN closer THEN 0 END IGNORE NULLS)
               OVER (PARTITION BY scan_id, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_block
      FROM m),
x AS (SELECT scan_id, path, pos,
        CASE WHEN opener OR (in_block = 1 AND closer) THEN NULL
             WHEN regexp_extract(l, '^require\\s+(\\S+)\\s+', 1) <> '' THEN regexp_extract(l, '^require\\s+(\\S+)\\s+', 1)
             WHEN in_block = 1 AND regexp_extract(l, '^(\\S+)\\s+', 1) <> '' THEN regexp_extract(l, '^(\\S+)\\s+', 1) END AS module
      FROM s)
SELECT scan_id, path, CAST(pos AS INTEGER) AS pos, module FROM x WHERE module IS NOT NULL
"""


@register("SRC-16", SRC16_SQL)
def q_src16(spark, sf_dir):
    return M.read_go_requires(V.v_code(spark, sf_dir))


CODE = f"({V.V_CODE_SQL})"
SRC05_SQL = f"""
WITH k AS (SELECT scan_id, min(path) AS keep FROM {CODE} WHERE starts_with(path, 'styles/') GROUP BY scan_id)
SELECT c.scan_id, c.path FROM {CODE} c LEFT JOIN k ON c.scan_id = k.scan_id
WHERE k.keep IS NULL  -- no ignore file in this scan
   OR (NOT starts_with(c.path, 'legacy/') AND NOT (regexp_matches(c.path, '^styles/[^/]*\\.css$') AND c.path <> k.keep))
UNION ALL SELECT DISTINCT scan_id, '.gitignore' FROM {CODE} WHERE starts_with(path, 'styles/')
UNION ALL SELECT DISTINCT scan_id, '.gitattributes' FROM {CODE}
"""


@register("SRC-05", SRC05_SQL)
def q_src05(spark, sf_dir):
    return C.apply_ignore(V.v_code_repo(spark, sf_dir)).select("scan_id", "path")


SRC06_SQL = f"""
SELECT scan_id, path FROM {CODE} WHERE NOT (ends_with(path, '.svelte') OR starts_with(path, 'ml/'))
UNION ALL SELECT DISTINCT scan_id, '.gitignore' FROM {CODE} WHERE starts_with(path, 'styles/')
UNION ALL SELECT DISTINCT scan_id, '.gitattributes' FROM {CODE}
"""


@register("SRC-06", SRC06_SQL)
def q_src06(spark, sf_dir):
    return C.skip_lfs(V.v_code_repo(spark, sf_dir)).select("scan_id", "path")


def _zip_group(key, pdf):
    import io
    import zipfile

    import pandas as pd
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for path, content in zip(pdf["path"], pdf["content"]):
            z.writestr(path, content)
    return pd.DataFrame({"rel_path": [f"{key[0]}.zip"], "data": [buf.getvalue()]})


SRC08_SQL = f"""
SELECT 'b' || regexp_extract(scan_id, '(\\d+)$', 1) || '_' || CAST(ord // 2500 AS VARCHAR) AS scan_id, path, ext, size, content
FROM {CODE}
"""


@register("SRC-08", SRC08_SQL)
def q_src08(spark, sf_dir):
    """Zip archives of the code corpus (one per brand and block of 2,500 part
    keys, about 100 files each, built per group and written from the tasks),
    expanded again by read_archives."""
    root = scratch(spark, f"archives-{uuid.uuid4().hex[:8]}")
    code = V.v_code(spark, sf_dir)
    key = F.concat(F.lit("b"), F.regexp_extract("scan_id", r"(\d+)$", 1), F.lit("_"),
                   F.floor(F.col("ord") / 2500).cast("long").cast("string"))
    zips = code.select(key.alias("archive"), "path", "content").groupBy("archive").applyInPandas(
        _zip_group, "rel_path string, data binary")
    K.write_blobs(zips, root)
    return C.read_archives(spark, root + "/*.zip").select("scan_id", "path", "ext", "size", "content")


def _encode_group(key, pdf):
    import pandas as pd
    text = "\n".join(pdf["doc"].tolist()) + "\n"
    which = int(key[1]) % 3
    data = (b"\xef\xbb\xbf" + text.encode("utf-8") if which == 0 else
            b"\xff\xfe" + text.encode("utf-16-le") if which == 1 else b"\xfe\xff" + text.encode("utf-16-be"))
    return pd.DataFrame({"rel_path": [f"scans-{key[0]}-{key[1]}.json"], "data": [data]})


SRC15_SQL = f"SELECT id, status, progress FROM {SCANS}"


@register("SRC-15", SRC15_SQL)
def q_src15(spark, sf_dir):
    """Scan documents as NDJSON files in UTF-8 / UTF-16LE / UTF-16BE with a
    BOM (at most 1,000 scans per file), decoded by read_json_any_encoding."""
    root = scratch(spark, f"json-{uuid.uuid4().hex[:8]}")
    s = V.v_scans(spark, sf_dir)
    o = V.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
                                                F.col("o_orderpriority").alias("prio"),
                                                F.floor(F.col("o_orderkey") / 1000).cast("long").alias("chunk"))
    docs = s.join(o, "id").select(F.regexp_replace("prio", r"[^A-Za-z0-9]", "").alias("prio"), "chunk",
                                  F.to_json(F.struct("id", "status", "progress")).alias("doc"))
    files = docs.groupBy("prio", "chunk").applyInPandas(_encode_group, "rel_path string, data binary")
    K.write_blobs(files, root)
    text = C.read_json_any_encoding(spark, root + "/*.json")
    lines = text.select(F.explode(F.split(F.col("json"), r"\r?\n")).alias("line")).filter(F.col("line") != "")
    return lines.select(F.from_json("line", "id string, status string, progress double").alias("d")).select("d.*")


def _snk07_sql():
    from codelens.plans.q_scores import AGG01_SQL, FEATURE_USAGE_SQL, TOP07_SQL
    def t(div):
        n = f"CAST(floor(CAST(size AS DOUBLE) / {div} * 10 + 0.5) AS BIGINT)"
        return f"CAST({n} // 10 AS VARCHAR) || '.' || CAST({n} % 10 AS VARCHAR)"
    hs = ("CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' "
          f"WHEN size < 1048576 THEN {t(1024)} || ' KB' "
          f"WHEN size < 1073741824 THEN {t(1048576)} || ' MB' "
          f"ELSE {t(1073741824)} || ' GB' END")
    return f"""
SELECT scan_id, 'overview' AS section, k AS key, v AS value, CAST(0 AS BIGINT) AS ord FROM (
  SELECT scan_id, unnest(['files', 'folders', 'lines', 'bytes']) AS k,
         unnest([CAST(files AS VARCHAR), CAST(folders AS VARCHAR), CAST(lines AS VARCHAR), CAST(bytes AS VARCHAR)]) AS v
  FROM ({AGG01_SQL}))
UNION ALL SELECT scan_id, 'features', feature, CAST(files AS VARCHAR), CAST(0 AS BIGINT) FROM ({FEATURE_USAGE_SQL})
UNION ALL SELECT scan_id, 'largest', path, {hs}, CAST(rank AS BIGINT) FROM ({TOP07_SQL})
"""


ORACLE["SNK-07"] = _snk07_sql()
