"""Report sinks and table maintenance (SNK-01..07).

Reports are built as DataFrames (one row per scan or per report line) and
written with Spark writers; nothing is assembled on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.dims import sql_text

API_VERSION = "v1"


# FIXED VALUES: the parts of the JSON report, in order; all are objects but the lists
REPORT_PARTS = ["repoDetails", "projectFeatures", "architecture", "compatibility", "securityAndPerformance",
                "healthAndMaintenance", "modernizationSuggestions", "analytics", "summaryLog"]
REPORT_LISTS = ["modernizationSuggestions"]
_JSON = {"ignoreNullFields": "false"}


def _json_value(c: F.Column) -> F.Column:
    """A column as one JSON value (quoted and escaped text, or null)."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), _JSON), r'(?s)^\{"v":(.*)\}$', 1)


def report_json(scans: DataFrame, parts: dict[str, DataFrame], generated_at: str) -> DataFrame:
    """SNK-01: ``(scan_id, document)`` — one JSON document per row of ``scans``
    (scan_id, repo_url) with every field of the report: id, repoUrl, the parts
    in order, generatedAt and apiVersion.

    A part is a table with one row per scan, which becomes an object of its
    columns (missing: ``{}``); a list part has any number of rows per scan and
    becomes an array sorted by its columns (missing: ``[]``).  A list holds what
    one report shows of one scan.  A part may also be a struct column of ``scans`` under its name."""
    own = [n for n in REPORT_PARTS if n in scans.columns and n not in parts]
    out = scans.select("scan_id", "repo_url", *[F.to_json(F.col(n), _JSON).alias(n) for n in own])
    for name in REPORT_PARTS:
        df = parts.get(name)
        if df is None:
            continue
        row = F.struct(*[c for c in df.columns if c != "scan_id"])
        value = F.to_json(F.array_sort(F.collect_list(row)), _JSON) if name in REPORT_LISTS else F.max(F.to_json(row, _JSON))
        out = out.join(df.groupBy("scan_id").agg(value.alias(name)), "scan_id", "left")
    fields = [F.concat(F.lit('"id":'), _json_value(F.col("scan_id"))), F.concat(F.lit('"repoUrl":'), _json_value(F.col("repo_url")))]
    for name in REPORT_PARTS:
        empty = F.lit("[]" if name in REPORT_LISTS else "{}")
        fields.append(F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(name), empty) if name in out.columns else empty))
    fields += [F.concat(F.lit('"generatedAt":'), _json_value(F.lit(generated_at))), F.lit(f'"apiVersion":"{API_VERSION}"')]
    return out.select("scan_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("document"))


def csv_value(v: F.Column) -> F.Column:
    """Quote only when the value contains ``"``, ``,`` or a newline."""
    s = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


# FIXED VALUES: what the reports show, in order.  A report line is about one topic of the
# facts table (scan_id, topic, ord, name, value): ("value", topic, ..., default) is one line per
# scan, ("list", topic, ...) one per fact, ("text", ...) a line as it stands.  A value without a default
# is left out where there is no fact.
BUNDLE_CSV = [
    ("value", "repo", "Meta", "Repo", ""), ("value", "branch", "Meta", "Branch", ""), ("value", "started", "Meta", "Started", ""),
    ("value", "completed", "Meta", "Completed", ""), ("value", "supported", "Analytics", "Supported", "0"),
    ("value", "partial", "Analytics", "Partial", "0"), ("value", "unsupported", "Analytics", "Unsupported", "0"),
    ("value", "suggested", "Analytics", "Suggested", "0"), ("list", "supported_feature", "Supported", "Feature"),
    ("list", "partial_feature", "Partial", "Feature"), ("list", "unsupported_item", "Unsupported", "Item"),
    ("list", "missing_config", "MissingConfig", "File"), ("list", "recommendation", "Recommendation", "Action"),
]
COMBINED_CSV = [
    ("value", "supported", "Analytics", "Supported", "0"), ("value", "partial", "Analytics", "Partial", "0"),
    ("value", "unsupported", "Analytics", "Unsupported", "0"), ("value", "suggested", "Analytics", "Suggested", "0"),
    ("list", "supported_feature", "Compatibility-Supported", "Feature"), ("list", "partial_feature", "Compatibility-Partial", "Feature"),
    ("list", "unsupported_item", "Compatibility-Unsupported", "Item"), ("list", "missing_config", "Compatibility-MissingConfig", "Config"),
    ("list", "recommendation", "Compatibility-Recommendation", "Action"), ("list", "framework", "Environment-Framework", None),
    ("list", "dependency", "Environment-Dependency", None), ("list", "upgrade", "Environment-Upgrade", None),
    ("list", "security", "Security", None), ("list", "performance", "Performance", None),
    ("value", "structure", "Architecture", "Structure", ""), ("value", "pattern", "Architecture", "Pattern", ""),
    ("value", "modularization", "Architecture", "Modularization", ""), ("list", "config_file", "Architecture-Config", "File"),
    ("value", "duration", "Summary", "Duration", ""), ("value", "files_ignored", "Summary", "FilesIgnored", "0"),
    ("value", "agent_version", "Summary", "AgentVersion", ""), ("value", "scan_date", "Summary", "ScanDate", ""),
    ("list", "log", "Summary-Error", "Log"),
]
MARKDOWN = [
    ("text", "# Baseline Scan Report"), ("text", ""), ("value", "repo", "- Repo: ", "", "N/A"), ("value", "license", "- License: ", "", "N/A"),
    ("value", "size", "- Size: ", "", "N/A"), ("value", "last_updated", "- Last Updated: ", "", "N/A"), ("text", ""), ("text", "## Analytics"),
    ("value", "supported", "- Supported: ", "", "0"), ("value", "partial", "- Partial: ", "", "0"),
    ("value", "unsupported", "- Unsupported: ", "", "0"), ("value", "suggested", "- Suggested: ", "", "0"), ("text", ""),
    ("text", "## Compatibility Report"), ("text", "### Supported Features"), ("list", "supported_feature", "- ", None), ("text", ""),
    ("text", "### Partial Features"), ("list", "partial_feature", "- ", None), ("text", ""), ("text", "### Unsupported/Deprecated Code"),
    ("list", "unsupported_item", "- ", None), ("text", ""), ("text", "### Missing Configurations"), ("list", "missing_config", "- ", None),
    ("text", ""), ("text", "### Recommended Migrations"), ("list", "recommendation", "- ", None), ("text", ""),
    ("text", "## Environment & Versioning"), ("text", "### Frameworks"), ("list", "framework", "- ", " "), ("text", "### Dependencies"),
    ("list", "dependency", "- ", " "), ("text", "### Recommended Upgrades"), ("list", "upgrade", "- ", ": "), ("text", ""),
    ("text", "## Security & Performance"), ("list", "security", "- [Security] ", ": "), ("list", "performance", "- [Perf] ", ": "),
    ("text", ""), ("text", "## Architecture"), ("value", "structure", "- Structure: ", "", "N/A"), ("value", "pattern", "- Pattern: ", "", "N/A"),
    ("value", "modularization", "- Modularization: ", "", "N/A"), ("text", "### Config Files"), ("list", "config_file", "- ", None),
    ("text", ""), ("text", "## Health & Maintenance"), ("value", "health_score", "- Health Score: ", "", "0"),
    ("value", "maintainability", "- Maintainability Index: ", "", "0"), ("value", "coverage", "- Test Coverage: ", "%", "0"),
    ("value", "build_status", "- Build Status: ", "", "N/A"), ("value", "contributors", "- Contributors: ", "", "0"),
    ("value", "commit_frequency", "- Commit Frequency: ", "", "N/A"), ("text", ""), ("text", "## Summary Log"),
    ("value", "duration", "- Duration: ", "", "N/A"), ("value", "files_ignored", "- Files Ignored: ", "", "0"),
    ("value", "agent_version", "- Agent Version: ", "", "N/A"), ("value", "scan_date", "- Scan Date: ", "", "N/A"),
    ("value", "files_scanned", "- Files Scanned: ", "", None), ("value", "files_analyzed", "- Files Analyzed: ", "", None),
    ("value", "issues_found", "- Issues Found: ", "", None), ("value", "resource_usage", "- Resource Usage: ", "", None),
    ("list", "warning", "- Warning: ", None), ("list", "log", "- LOG: ", None),
]


def topics_of(df: DataFrame, topics: dict[str, F.Column], lists: dict[str, F.Column] | None = None) -> DataFrame:
    """(scan_id, topic, name) of a table with one row per scan: a row per topic, and
    one per entry of each array in ``lists``, in one pass over the table."""
    one = F.array(*[F.struct(F.lit(t).alias("topic"), c.cast("string").alias("name")) for t, c in topics.items()])

    def entries(topic: str, values: F.Column) -> F.Column:
        return F.transform(values, lambda v: F.struct(F.lit(topic).alias("topic"), v.cast("string").alias("name")))

    more = [entries(t, c) for t, c in (lists or {}).items()]
    return df.select("scan_id", F.explode(F.concat(one, *more) if more else one).alias("_e")).select("scan_id", "_e.topic", "_e.name")


def report_facts(parts: list[DataFrame]) -> DataFrame:
    """(scan_id, topic, ord, name, value) from tables (scan_id, topic, name[, value][, ord]); rows without a topic are left out."""
    out = []
    for df in parts:
        value = F.col("value").cast("string") if "value" in df.columns else F.lit(None).cast("string")
        order = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
        out.append(df.where(F.col("topic").isNotNull()).select("scan_id", "topic", order.alias("ord"), F.col("name").cast("string").alias("name"),
                                                               value.alias("value")))
    return reduce(DataFrame.unionByName, out)


def report_lines(scans: DataFrame, facts: DataFrame, layout: list[tuple], csv: bool) -> DataFrame:
    """``(scan_id, section_ord, ord, line)`` of a layout for every scan; lines of a
    list come in order of ``ord`` and text.  The layout has a fixed number of entries, the
    facts are joined once by scan and topic."""
    fixed = [(i, e[0], e[1], *((None,) * 3 if e[0] == "text" else e[2:5])) for i, e in enumerate(layout) if e[0] != "list"]
    lists = [(i, e[1], e[2], e[3]) for i, e in enumerate(layout) if e[0] == "list"]
    spark = scans.sparkSession
    entry = F.expr("array(" + ", ".join(
        f"named_struct('section_ord', {i}, 'kind', '{kind}', 'topic', {sql_text(topic)}, "
        + ", ".join(f"'{n}', {sql_text(v)}" for n, v in zip("abd", rest)) + ")" for i, kind, topic, *rest in fixed) + ")")
    # no topic is in both kinds of entries: every branch of the facts is computed for one of them
    single = facts.where(F.col("topic").isin([t for _i, kind, t, *_r in fixed if kind == "value"])).groupBy("scan_id", "topic").agg(F.max(F.coalesce("value", "name")).alias("value"))
    rows = scans.select("scan_id", F.explode(entry).alias("e")).select("scan_id", "e.*").join(single, ["scan_id", "topic"], "left")
    value = F.coalesce("value", "d")
    if csv:
        line = F.concat_ws(",", csv_value(F.col("a")), csv_value(F.col("b")), csv_value(value))
    else:
        line = F.when(F.col("kind") == "text", F.col("topic")).otherwise(F.concat("a", value, F.coalesce("b", F.lit(""))))
    one = rows.select("scan_id", "section_ord", F.lit(0).cast("long").alias("ord"), line.alias("line")).filter(F.col("line").isNotNull())
    kinds = F.broadcast(spark.createDataFrame(lists, "section_ord int, topic string, a string, b string"))  # a fixed list
    hits = facts.where(F.col("topic").isin([t for _i, t, _a, _b in lists])).join(kinds, "topic").join(scans.select("scan_id").distinct(), "scan_id", "left_semi")
    if csv:
        key = F.coalesce("b", "name")
        shown = F.when(F.col("b").isNotNull(), F.col("name")).otherwise(F.col("value"))
        line = F.concat_ws(",", csv_value(F.col("a")), csv_value(key), csv_value(shown))
    else:
        line = F.concat("a", "name", F.when(F.col("b").isNotNull(), F.concat("b", F.coalesce("value", F.lit("")))).otherwise(F.lit("")))
    return one.unionByName(hits.select("scan_id", "section_ord", "ord", line.alias("line")))


def report_text(lines: DataFrame, header: str | None = None, name: str = "text") -> DataFrame:
    """One text per scan: the header, then the lines in order.  A text is one
    scan's report; write ``lines`` themselves for anything larger."""
    g = lines.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("section_ord", "ord", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return g.select("scan_id", (body if header is None else F.concat(F.lit(header + "\n"), body)).alias(name))


def upsert(target: DataFrame, updates: DataFrame, key: str = "id", ts_col: str | None = "updated_at") -> DataFrame:
    """SNK-05: last write wins by key — rows of ``target`` whose key is updated
    are replaced; ``updated_at`` is refreshed on the new rows."""
    u = updates
    if ts_col and ts_col in target.columns:
        u = u.withColumn(ts_col, F.current_timestamp())
    keep = target.join(u.select(key).distinct(), key, "left_anti")
    return keep.unionByName(u, allowMissingColumns=True)


def delete_scans(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """SNK-06: remove rows whose key is listed."""
    return target.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, key: str = "scan_id") -> None:
    """SNK-05 on storage: a table partitioned by ``key``; only the partitions
    of updated keys are rewritten (dynamic partition overwrite).  A key's rows
    are brought together first, so that it gets one file, not one per task."""
    (updates.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def scan_overview(stats: DataFrame, features: DataFrame, largest: DataFrame) -> DataFrame:
    """SNK-07: one ``(scan_id, section, key, value, ord)`` result set:
    overview numbers, feature usage and the largest files."""
    o = stats.select("scan_id", F.lit("overview").alias("section"),
                     F.explode(F.create_map(*[x for c in stats.columns if c != "scan_id"
                                              for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value"),
                     F.lit(0).cast("long").alias("ord"))
    f = features.select("scan_id", F.lit("features").alias("section"), F.col("feature").alias("key"),
                        F.col("files").cast("string").alias("value"), F.lit(0).cast("long").alias("ord"))
    lg = largest.select("scan_id", F.lit("largest").alias("section"), F.col("path").alias("key"),
                        F.col("human_size").alias("value"), F.col("rank").cast("long").alias("ord"))
    return o.unionByName(f).unionByName(lg)


def write_blobs(df: DataFrame, root: str) -> int:
    """Write each row's ``data`` bytes to ``root/<rel_path>`` from the
    executor tasks (pyarrow filesystem: local, HDFS, S3).  File names are
    deterministic, so a retried task overwrites the same files.  Returns the
    number of files written."""
    from codelens.sources.corpus import _fs_and_path

    def fn(batches):
        import pandas as pd
        fs, base = _fs_and_path(root)
        base = base.rstrip("/")
        for pdf in batches:
            sizes = []
            for rel, data in zip(pdf["rel_path"].tolist(), pdf["data"].tolist()):
                path = f"{base}/{rel}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(bytes(data))
                sizes.append(len(data))
            yield pd.DataFrame({"rel_path": pdf["rel_path"].values, "bytes": sizes})
    return df.select("rel_path", "data").mapInPandas(fn, "rel_path string, bytes long").count()


def write_diffs(parts: DataFrame, root: str, by: str = "scan_id") -> int:
    """Write the parts of unified diffs (``diff_parts``) to ``root/<scan>/<first byte>.diff``
    from the tasks: read in order of their names and joined by a line feed they are the diff."""
    name = F.concat(F.url_encode(F.col(by).cast("string")), F.lit("/"), F.lpad(F.col("at").cast("string"), 15, "0"), F.lit(".diff"))
    return write_blobs(parts.where(F.col(by).isNotNull()).select(name.alias("rel_path"), F.encode("text", "UTF-8").alias("data")), root)
