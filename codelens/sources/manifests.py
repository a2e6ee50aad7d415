"""Manifest sources (SRC-09, SRC-16): dependency rows from files already in
the corpus table.  Parsing is column functions on the content column
(``from_json``, ``split``/``posexplode``, windows over line numbers), so a
manifest is processed where its row lives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.scalar import basename, dirname, js_trim

PKG_SCHEMA = ("name string, dependencies map<string,string>, devDependencies map<string,string>, "
              "scripts map<string,string>")


def package_manifests(files: DataFrame) -> DataFrame:
    """Every ``package.json`` outside ``node_modules``, parsed (broken JSON ->
    NULL struct, kept so callers can count it)."""
    p = F.regexp_replace("path", r"\\", "/")
    m = files.filter((basename(F.col("path")) == "package.json") & ~p.contains("node_modules"))
    return m.select("scan_id", p.alias("path"), dirname(p).alias("package_dir"),
                    F.from_json("content", PKG_SCHEMA).alias("pkg"))


def read_manifests(files: DataFrame) -> DataFrame:
    """SRC-09: dependency inventory ``(scan_id, package_dir, name, version,
    dev)``, prod and dev, duplicates on (dir, name, version, dev) removed."""
    m = package_manifests(files)
    prod = m.select("scan_id", "package_dir", F.explode_outer("pkg.dependencies").alias("name", "version"),
                    F.lit(False).alias("dev"))
    dev = m.select("scan_id", "package_dir", F.explode_outer("pkg.devDependencies").alias("name", "version"),
                   F.lit(True).alias("dev"))
    return prod.unionByName(dev).filter(F.col("name").isNotNull()).dropDuplicates(
        ["scan_id", "package_dir", "name", "version", "dev"])


def read_go_requires(files: DataFrame) -> DataFrame:
    """SRC-16: module paths required by each ``go.mod`` — single-line
    ``require x v`` and ``require ( ... )`` blocks.

    Parsed inside the file's row (no shuffle): the positions of the block
    open / close markers are collected once; a line is inside a block when
    the last marker before it is an opener."""
    g = files.filter(basename(F.col("path")) == "go.mod").select("scan_id", "path", "content")
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), lambda x: js_trim(x))
    g = g.select("scan_id", "path", lines.alias("_l"))
    marks = F.filter(F.transform("_l", lambda ln, i: F.when(
        ln.rlike(r"^require\s*\(\s*$"), F.struct(i.alias("pos"), F.lit(1).alias("open"))).when(
        ln.rlike(r"^\)"), F.struct(i.alias("pos"), F.lit(0).alias("open")))), lambda m: m.isNotNull())
    g = g.withColumn("_m", marks)
    items = F.transform("_l", lambda ln, i: F.struct(
        i.alias("pos"), ln.alias("l"),
        F.coalesce(F.array_max(F.filter("_m", lambda m: m["pos"] < i))["open"], F.lit(0)).alias("in_block")))
    x = g.select("scan_id", "path", F.explode(items).alias("x")).select("scan_id", "path", "x.pos", "x.l", "x.in_block")
    opener = F.col("l").rlike(r"^require\s*\(\s*$")
    closer = F.col("l").rlike(r"^\)")
    in_block = F.col("in_block") == 1
    single = F.regexp_extract("l", r"^require\s+(\S+)\s+", 1)
    blockm = F.regexp_extract("l", r"^(\S+)\s+", 1)
    mod = (F.when(opener | (in_block & closer), None).when(single != "", single)
           .when(in_block & (blockm != ""), blockm))
    return x.select("scan_id", "path", "pos", mod.alias("module")).filter(F.col("module").isNotNull())
