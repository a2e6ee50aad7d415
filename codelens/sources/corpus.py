"""Corpus sources and path filters (SRC-01..08, SRC-13..15).

A corpus is read once into the ``files`` table ``(scan_id, path, dir,
basename, ext, size, content)``; every detector then works on that table.
For repeated analysis store it as parquet partitioned by ``scan_id`` (then
per-scan queries prune partitions and binaryFile listing is paid once).
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.dims import broadcast_if_small
from codelens.functions.scalar import basename, dirname, ext
from codelens.session import ensure_checkpoint_dir
from codelens.sources.archives import archive_rows

FILES_SCHEMA = "scan_id string, path string, dir string, basename string, ext string, size long, content string"

# FIXED VALUES: directories pruned at any depth (SRC-03)
DEFAULT_PRUNED_DIRS = [
    "node_modules", ".git", "dist", "build", ".next", ".nuxt",
    "coverage", ".cache", "tmp", "vendor", "target", "out",
    ".svelte-kit", ".gradle", "__pycache__", "venv", ".venv",
    ".mypy_cache", ".pytest_cache", ".yarn", ".pnpm", ".idea", ".vscode",
]


def _decode(content) -> F.Column:
    """Bytes -> UTF-8 text, malformed bytes as U+FFFD; NULL when the bytes
    contain a NUL (binary)."""
    return F.when(F.contains(content, F.lit(bytearray(1))), None).otherwise(F.make_valid_utf8(content.cast("string")))


def _text(data: bytes) -> str | None:
    """The same for bytes that a Python task has read."""
    return None if b"\x00" in data else data.decode("utf-8", "replace")


def with_layout(df: DataFrame) -> DataFrame:
    p = F.regexp_replace("path", r"\\", "/")
    return df.withColumn("path", p).withColumn("dir", dirname(F.col("path"))).withColumn(
        "basename", basename(F.col("path"))).withColumn("ext", ext(F.col("path")))


def _fs_and_path(uri: str):
    """pyarrow filesystem + path for a Spark/Hadoop URI (file:, hdfs:, s3a:)."""
    import pyarrow.fs as pafs
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    fs, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs, path


#: A task hands on what it has read whenever this much has come together.
EMIT_BYTES = 16 << 20


def _emit(rows: list, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _lister(root_uri: str, prune: frozenset):
    """mapInPandas body: the entries of each directory, as (path, size, is_dir);
    pruned directory names are not handed on."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        fs, root = _fs_and_path(root_uri)
        root = root.rstrip("/")
        for pdf in batches:
            for rel in pdf["path"].tolist():
                found = fs.get_file_info(pafs.FileSelector(f"{root}/{rel}" if rel else root, recursive=False))
                rows = [(i.path[len(root) + 1:], int(i.size or 0), i.type == pafs.FileType.Directory) for i in found
                        if not (i.type == pafs.FileType.Directory and i.base_name in prune)]
                yield _emit(rows, ["path", "size", "is_dir"])
    return fn


def _reader(root_uri: str):
    """mapInPandas body: the text of each listed file, a few megabytes at a time."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs_and_path(root_uri)
        root, names = root.rstrip("/"), ["path", "size", "content"]
        for pdf in batches:
            rows, held = [], 0
            for rel, size in zip(pdf["path"].tolist(), pdf["size"].tolist()):
                with fs.open_input_stream(f"{root}/{rel}") as fh:
                    rows.append((rel, int(size), _text(fh.read())))
                held += int(size)
                if held >= EMIT_BYTES:
                    yield _emit(rows, names)
                    rows, held = [], 0
            if rows:
                yield _emit(rows, names)
    return fn


def hidden_files(spark: SparkSession, root: str, max_bytes: int | None = None, glob: str | None = None,
                 prune: list[str] | None = None) -> DataFrame:
    """(path, size, content) of the files that Spark's own source skips: empty
    ones, and those whose name, or a directory above them, starts with '.' or '_'.

    Directories are listed level by level, each level one distributed job, so
    directories that hold nothing visible are found too; pruned names are never
    entered.  The listing of a level is kept in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    level = spark.createDataFrame([("",)], "path string")
    found = []
    names = frozenset(prune or [])
    while True:
        entries = (level.repartition(spark.sparkContext.defaultParallelism)
                   .mapInPandas(_lister(root, names), "path string, size long, is_dir boolean")).checkpoint(eager=True)
        found.append(entries.filter(~F.col("is_dir")).select("path", "size"))
        level = entries.filter("is_dir").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionByName, found)
    files = files.filter(F.col("path").rlike(r"(^|/)[._]") | (F.col("size") == 0))
    if max_bytes:
        files = files.filter(F.col("size") <= max_bytes)
    if glob:
        files = files.filter(F.regexp_extract("path", r"[^/]*$", 0).rlike(_glob_re(glob)))
    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_reader(root), "path string, size long, content string")


def _glob_re(glob: str) -> str:
    import fnmatch
    return fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")


def read_corpus(spark: SparkSession, root: str, scan_id: str, max_bytes: int | None = None,
                glob: str | None = None, include_hidden: bool = True, prune: list[str] | None = None) -> DataFrame:
    """SRC-01: every file under ``root`` (recursive), paths relative to root.

    Visible files come from the ``binaryFile`` source (parallel listing on the
    cluster; the ``length`` filter is pushed into the listing, so over-size
    files are never read).  Spark's listing skips names starting with '.' or
    '_', but a scan must see ``.gitignore``, ``.env`` or ``.github/``: with
    ``include_hidden`` these come from ``hidden_files``, under the same ``glob``
    and size limit.  Directories named in ``prune`` are left out at any depth.
    Malformed bytes become U+FFFD, binary files (with a NUL) have no content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    if max_bytes:
        df = df.filter(F.col("length") <= max_bytes)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:", ""), "^" + _re_escape(prefix.replace("file:", "")), "")
    out = df.select(rel.alias("path"), F.col("length").alias("size"), "content")
    if prune:
        out = out.filter(~F.arrays_overlap(F.split(dirname(F.col("path")), "/"), F.array(*[F.lit(n) for n in prune])))
    out = out.select("path", "size", _decode(F.col("content")).alias("content"))
    if include_hidden:
        out = out.unionByName(hidden_files(spark, root, max_bytes, glob, prune))
    out = out.select(F.lit(scan_id).alias("scan_id"), "path", "size", "content")
    return with_layout(out).select(*[c.split()[0] for c in FILES_SCHEMA.split(", ")])


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def by_extension(files: DataFrame, exts: list[str] | None) -> DataFrame:
    """SRC-02: keep files whose lower extension is listed (empty list: all)."""
    if not exts:
        return files
    return files.filter(F.col("ext").isin(*[e.lower() for e in exts]))


def prune_dirs(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """SRC-03: drop files under a pruned directory name at any depth."""
    names = DEFAULT_PRUNED_DIRS + list(extra or [])
    segs = F.split(F.col("dir"), "/")
    return files.filter(~F.arrays_overlap(segs, F.array(*[F.lit(n) for n in names])))


def exclude_paths(files: DataFrame, patterns: list[str] | str | None) -> DataFrame:
    """SRC-04: drop paths containing any pattern (lists split on ``;`` or
    ``,``, trimmed, distinct; backslashes normalised)."""
    import re
    raw = patterns if isinstance(patterns, list) else re.split(r"[;,]", patterns or "")
    pats = sorted({p.strip().replace("\\", "/") for p in raw if p and p.strip()})
    cond = F.lit(False)
    for p in pats:
        cond = cond | F.col("path").contains(p)
    return files.filter(~cond)


def glob_to_regex(col: F.Column) -> F.Column:
    """Glob -> anchored regex as a column: ``**`` -> ``.*``, ``*`` -> ``[^/]*``,
    ``?`` -> ``[^/]``; other regex metacharacters escaped."""
    g = F.regexp_replace(col, r"([.+^$(){}|\[\]\\])", r"\\$1")
    g = F.regexp_replace(g, r"\*\*", "\u0000")
    g = F.regexp_replace(g, r"\*", "[^/]*")
    g = F.regexp_replace(g, r"\?", "[^/]")
    g = F.regexp_replace(g, "\u0000", ".*")
    return F.concat(F.lit("^(.*/)?"), g, F.lit("$"))


def _lines_of(files: DataFrame, name: str) -> DataFrame:
    """(scan_id, ord, l): trimmed lines of each scan's root file ``name``, without blanks and comments."""
    lines = files.filter(F.col("path") == name).select(
        "scan_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("ord", "line"))
    return lines.select("scan_id", "ord", F.trim("line").alias("l")).filter((F.col("l") != "") & ~F.col("l").startswith("#"))


def _pattern_key(glob: F.Column) -> F.Column:
    """What a path must have, as one of its ``_path_keys``, to match the pattern: the
    longest segment without wildcards; else the last suffix from a dot, the first
    character or the last one; else nothing but ``*``.  Matches begin and end
    where a segment does, so the ends of the pattern are ends of segments."""
    segments = F.split(glob, "/")
    literal = F.array_max(F.transform(F.filter(segments, lambda s: (s != "") & ~s.rlike(r"[*?]")), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    head, tail = F.regexp_extract(glob, r"^([^*?/]*)", 1), F.regexp_extract(glob, r"([^*?/]*)$", 1)
    suffix = F.regexp_extract(tail, r"(\.[^.]*)$", 1)
    return (F.when(literal.isNotNull(), F.concat(F.lit("s"), literal["s"]))
            .when(suffix != "", F.concat(F.lit("d"), suffix))
            .when(head != "", F.concat(F.lit("p"), F.substring(head, 1, 1)))
            .when(tail != "", F.concat(F.lit("e"), F.substring(tail, -1, 1)))
            .otherwise(F.lit("*")))


def _path_keys(path: F.Column) -> F.Column:
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_distinct(F.concat(
        F.array(F.lit("*")), F.transform(segments, lambda s: F.concat(F.lit("s"), s)),
        F.transform(segments, lambda s: F.concat(F.lit("d"), F.regexp_extract(s, r"(\.[^.]*)$", 1))),
        F.transform(segments, lambda s: F.concat(F.lit("p"), F.substring(s, 1, 1))),
        F.transform(segments, lambda s: F.concat(F.lit("e"), F.substring(s, -1, 1)))))


def last_match(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(scan_id, path, verdict): for each path that a pattern of its scan matches, the
    verdict of the last one.

    Patterns are (scan_id, ord, glob, below, verdict); one that is ``below`` also
    matches whatever lies under what it names.  Paths meet patterns by an
    equi-join on (scan, key); patterns without wildcards are then compared as
    plain strings, only the others as regular expressions.  File contents take no
    part; null scans and null paths match nothing."""
    wild = F.col("glob").rlike(r"[*?]")
    regex = glob_to_regex(F.col("glob"))
    patterns = patterns.select(
        F.col("scan_id").alias("_scan"), _pattern_key(F.col("glob")).alias("_key"), "ord", "verdict", "below",
        F.when(~wild, F.concat(F.lit("/"), "glob")).alias("plain"),
        F.when(wild & F.col("below"), F.regexp_replace(regex, r"\$$", r"(/.*)?\$")).when(wild, regex).alias("re"))
    keyed = files.select("scan_id", "path", F.explode(_path_keys(F.col("path"))).alias("_key"))
    met = keyed.join(broadcast_if_small(patterns), (F.col("scan_id") == F.col("_scan")) & (keyed["_key"] == patterns["_key"]))
    rooted = F.concat(F.lit("/"), "path")
    plain = F.when(F.col("below"), F.contains(F.concat(rooted, F.lit("/")), F.concat("plain", F.lit("/")))).otherwise(F.endswith(rooted, F.col("plain")))
    hit = met.filter(F.when(F.col("plain").isNotNull(), plain).otherwise(F.regexp_like("path", F.col("re"))))
    return hit.groupBy("scan_id", "path").agg(F.max(F.struct("ord", "verdict"))["verdict"].alias("verdict"))


def _without(files: DataFrame, matched: DataFrame) -> DataFrame:
    """The files that are not named; the names are broadcast if they are few bytes, so contents stay where they are."""
    named = matched.select(F.col("scan_id").alias("_scan"), F.col("path").alias("_path"))
    return files.join(broadcast_if_small(named), (F.col("scan_id") == F.col("_scan")) & (F.col("path") == F.col("_path")), "left_anti")


def skip_lfs(files: DataFrame) -> DataFrame:
    """SRC-06: drop files matched by a ``.gitattributes`` line declaring
    ``filter=lfs``, ``diff=lfs`` or ``merge=lfs``."""
    lfs = _lines_of(files, ".gitattributes").filter(F.col("l").rlike(r"(^|\s)(filter|diff|merge)=lfs(\s|$)"))
    pats = lfs.select("scan_id", "ord", F.split("l", r"\s+")[0].alias("glob"), F.lit(False).alias("below"), F.lit(True).alias("verdict"))
    return _without(files, last_match(files, pats))


def apply_ignore(files: DataFrame) -> DataFrame:
    """SRC-05: root ``.gitignore`` of each scan — ordered patterns, ``!``
    negates, the last matching pattern decides."""
    pats = _lines_of(files, ".gitignore")
    neg = F.col("l").startswith("!")
    glob = F.regexp_replace(F.when(neg, F.expr("substring(l, 2)")).otherwise(F.col("l")), r"^/|/$", "")
    # a directory pattern also matches everything below it
    pats = pats.select("scan_id", "ord", glob.alias("glob"), F.lit(True).alias("below"), (~neg).alias("verdict"))
    return _without(files, last_match(files, pats).filter("verdict"))


def max_size(files: DataFrame, max_bytes: int) -> DataFrame:
    """SRC-07: drop files above ``max_bytes`` (0 = no cap)."""
    return files if not max_bytes else files.filter(F.col("size") <= max_bytes)


def read_archives(spark: SparkSession, glob_path: str) -> DataFrame:
    """SRC-08: expand many zip archives at once, each by as many tasks as its
    size asks for (see ``archives``); scan id = archive file name.  Entries keep
    their whole content; what cannot be read is in ``bad_archives``."""
    return with_layout(archive_rows(spark, glob_path).filter(F.col("error").isNull()).drop("error"))


def bad_archives(spark: SparkSession, glob_path: str) -> DataFrame:
    """The ``bad_rows`` of SRC-08: (scan_id, path, size, error) of archives (null
    path) and entries that cannot be read."""
    return archive_rows(spark, glob_path).filter(F.col("error").isNotNull()).drop("content")


def read_changed_paths(spark: SparkSession, path: str, scan_id: str | None) -> DataFrame:
    """SRC-14: ``git diff --name-only`` text -> trimmed, non-blank,
    slash-normalised, distinct paths.  With ``scan_id=None`` the scan comes
    from a ``scan_id=<id>`` partition directory of ``path``."""
    t = spark.read.text(path)
    p = F.regexp_replace(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\\", "/")
    sid = F.lit(scan_id) if scan_id is not None else F.col("scan_id").cast("string")
    return t.select(sid.alias("scan_id"), p.alias("path")).filter(F.col("path") != "").distinct()


def decode_any(content: F.Column) -> F.Column:
    """SRC-15: bytes -> text for UTF-8 / UTF-16LE / UTF-16BE with BOM stripped;
    malformed UTF-8 becomes U+FFFD."""
    h = F.hex(F.substring(content, 1, 3))
    le, be, u8 = h.startswith("FFFE"), h.startswith("FEFF"), h.startswith("EFBBBF")
    body3 = F.expr("substring(content, 4)")
    def utf8(c: F.Column) -> F.Column:
        return F.make_valid_utf8(c.cast("string"))
    even = F.expr("substring(content, 3, (length(content) div 2) * 2 - 2)")  # a cut-off last byte is no character
    return (F.when(le, F.decode(even, "UTF-16LE")).when(be, F.decode(even, "UTF-16BE"))
            .when(u8, utf8(body3)).otherwise(utf8(content)))


def read_json_any_encoding(spark: SparkSession, glob_path: str) -> DataFrame:
    """SRC-15: scan JSON files in any of the three encodings as text rows."""
    df = spark.read.format("binaryFile").load(glob_path)
    return df.select("path", decode_any(F.col("content")).alias("json"))
