"""Tool-output sources (SRC-10..12, UDF-03): JSON already produced by
external scanners, read as data (the tools themselves are not run)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.severity import semgrep_severity

def _parsed(docs: DataFrame, col: str) -> DataFrame:
    """``docs`` with ``col`` parsed once, as the variant ``_v``; its fields are read off that.
    Names are case-sensitive.  A text that is no JSON, has a name twice in an object or is larger
    than Spark lets a variant be is null there and one of ``bad_records``."""
    return docs.withColumn("_v", F.try_parse_json(col))


def _at(v: str, *paths: str, kind: str = "string") -> F.Column:
    """The first of the paths that the variant has, as ``kind``; values of other kinds count as missing."""
    return F.coalesce(*[F.try_variant_get(F.col(v), "$." + p, kind) for p in paths])


def _filled(v: str, *paths: str) -> F.Column:
    """The first of the paths whose text is not empty."""
    return F.coalesce(*[F.nullif(_at(v, p), F.lit("")) for p in paths])


def bad_records(docs: DataFrame, col: str = "json") -> DataFrame:
    """The ``bad_rows`` of SRC-10..12: rows whose ``col`` has text that cannot be parsed (a
    tool's log lines among its records, cut-off documents), columns unchanged."""
    return _parsed(docs, col).filter(F.col("_v").isNull() & (F.trim(F.col(col)) != "")).drop("_v")


def read_semgrep(docs: DataFrame, col: str = "json") -> DataFrame:
    """SRC-10: semgrep JSON per scan -> findings (severity error/high/critical
    -> High, warning/medium -> Medium, else Low), with the result ordinal.
    Unparsable documents yield no rows."""
    r = _parsed(docs, col).select("scan_id", F.posexplode(F.try_variant_get("_v", "$.results", "array<variant>")).alias("ord", "_r"))
    return r.select(
        "scan_id", "ord", F.lit("vulnerability").alias("kind"), F.lit("semgrep").alias("source"),
        F.coalesce(_at("_r", "check_id", "extra.message"), F.lit("Semgrep finding")).alias("title"),
        semgrep_severity(_at("_r", "extra.severity")).alias("severity"),
        F.coalesce(_at("_r", "path"), F.lit("")).alias("file"),
        F.struct(_at("_r", "start.line", kind="int").alias("start"), _at("_r", "end.line", kind="int").alias("end")).alias("range"),
        F.coalesce(_at("_r", "extra.message"), F.lit("")).alias("description"))


def read_trufflehog(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-11: trufflehog NDJSON lines -> secrets; lines that are no JSON object
    dropped; detector / path / verified from their alternative field names."""
    ok = _parsed(lines, col).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    return ok.select(
        "scan_id", "ord", F.lit("secret").alias("kind"), F.lit("trufflehog").alias("source"),
        F.coalesce(_at("_v", "DetectorName", "detector", "rule"), F.lit("unknown")).alias("title"),
        F.lit("High").alias("severity"),
        F.coalesce(_filled("_v", "SourceMetadata.Data.filepath", "path", "File"), F.lit("")).alias("file"),
        (F.coalesce(_at("_v", "Verified", kind="boolean"), F.lit(False))
         | F.coalesce(_at("_v", "verified", kind="boolean"), F.lit(False))).alias("verified"))


def read_audit(docs: DataFrame, col: str = "json") -> DataFrame:
    """SRC-12: npm-audit JSON -> vulnerability rows (one per package)."""
    p = _parsed(docs, col).select("scan_id", "dir_ord", F.explode(F.try_variant_get("_v", "$.vulnerabilities", "map<string,variant>")).alias("name", "_p"))
    return p.select("scan_id", "dir_ord", "name", _at("_p", "severity").alias("severity"), _at("_p", "range").alias("range"),
                    _at("_p", "fixAvailable").alias("fix"))


def read_outdated(docs: DataFrame, col: str = "json") -> DataFrame:
    """SRC-12: outdated JSON of several package dirs -> ``(scan_id, name,
    current, latest)``; the later directory (``dir_ord``) wins per name."""
    p = _parsed(docs, col).select("scan_id", "dir_ord", F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("name", "_p"))
    return p.groupBy("scan_id", "name").agg(F.max(F.struct("dir_ord", _at("_p", "current").alias("current"), _at("_p", "latest").alias("latest"))).alias("v")).select(
        "scan_id", "name", "v.current", "v.latest")


def ingest_tool(name: str, df: DataFrame) -> DataFrame:
    """UDF-03: route a tool's raw output table to its reader."""
    readers = {"semgrep": read_semgrep, "trufflehog": read_trufflehog, "npm-audit": read_audit,
               "npm-outdated": read_outdated}
    if name not in readers:
        raise ValueError(f"unknown tool {name!r}; known: {sorted(readers)}")
    return readers[name](df)

