"""Zip archives of any size as files (SRC-08).

An archive is never one value.  One small task per archive reads its directory
by range requests and hands on one row per entry; the entries are then dealt to
tasks by (archive, span), where a span is a run of entries of about
``SPAN_BYTES`` compressed bytes, and each task reads just the bytes of its own
entries.  So one big archive is read by many tasks, a lost task reads its spans
again, and only the directory of an archive (about 100 bytes an entry) is
shuffled.  Entries are read one at a time and handed on every few megabytes.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zipfile
import zlib
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes of consecutive entries that are read together.
SPAN_BYTES = 32 << 20
#: A task gets about this much; beyond ``MAX_TASKS`` tasks get more spans each, which are read one after the other.
TASK_BYTES, MAX_TASKS = 256 << 20, 100_000
#: The most bytes that one value of a row can hold.
VALUE_BYTES = (1 << 31) - (1 << 16)

_ENTRY = ("scan_id string, uri string, path string, size long, span long, at long, packed long, crc long, method int, "
          "encrypted boolean, error string")
_ROW = "scan_id string, path string, size long, content string, error string"
_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]


def _directories(span_bytes: int):
    """mapInPandas body: (uri, length, scan_id) -> one row per entry; an archive whose
    directory cannot be read is a row without a path."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codelens.sources.corpus import _fs_and_path
        for pdf in batches:
            for uri, length, scan_id in zip(pdf["uri"], pdf["length"], pdf["scan_id"]):
                fs, path = _fs_and_path(uri)
                try:
                    with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                        entries = [i for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, NotImplementedError, struct.error, ValueError) as e:  # ValueError: a seek before the start
                    yield pd.DataFrame([(scan_id, uri, None, int(length), 0, 0, 0, 0, 0, False, str(e))], columns=_NAMES)
                    continue
                before = 0
                for first in range(0, len(entries), 50_000):
                    rows = []
                    for i in entries[first:first + 50_000]:
                        rows.append((scan_id, uri, i.filename, i.file_size, before // span_bytes, i.header_offset, i.compress_size,
                                     i.CRC, i.compress_type, bool(i.flag_bits & 1), None))
                        before += i.compress_size
                    yield pd.DataFrame(rows, columns=_NAMES)
    return fn


def _unpack(packed: bytes, method: int, size: int) -> bytes:
    """The bytes of an entry; no more than one beyond ``size`` are ever made."""
    if method == zipfile.ZIP_STORED:
        return packed
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompressobj(-15).decompress(packed, size + 1)
    if method == zipfile.ZIP_BZIP2:
        return bz2.BZ2Decompressor().decompress(packed, size + 1)
    if method == zipfile.ZIP_LZMA:
        # two bytes of version, two of length, then the properties of the raw filter
        n = struct.unpack("<H", packed[2:4])[0]
        lc_lp_pb, dictionary = struct.unpack("<BI", packed[4:9])
        spec = {"id": lzma.FILTER_LZMA1, "dict_size": dictionary, "lc": lc_lp_pb % 9, "lp": lc_lp_pb // 9 % 5, "pb": lc_lp_pb // 45}
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec]).decompress(packed[4 + n:], size + 1)
    raise NotImplementedError(f"compression method {method} is not supported")


def _read_entry(raw, at: int, packed: int, size: int, crc: int, method: int, encrypted: bool) -> bytes:
    """One entry by two range requests: its own header, whose names may differ in length from the directory's, and its bytes."""
    if encrypted:
        raise RuntimeError("the entry is encrypted")
    if max(size, packed) > VALUE_BYTES:
        raise NotImplementedError(f"{size} bytes are more than one value can hold")
    raw.seek(at)
    header = raw.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no entry where the directory names one")
    name, extra = struct.unpack("<HH", header[26:30])
    raw.seek(at + 30 + name + extra)
    data = _unpack(raw.read(packed), method, size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("bad CRC-32 or length")
    return data


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries with their texts, a few megabytes at a time; what cannot be read becomes a row with an error."""
    from codelens.sources.corpus import EMIT_BYTES, _fs_and_path, _text
    names = [c.split()[0] for c in _ROW.split(", ")]
    opened, raw = None, None
    try:
        for pdf in batches:
            rows, held = [], 0
            for e in pdf.itertuples(index=False):
                if e.path is None:
                    rows.append((e.scan_id, None, e.size, None, e.error))
                    continue
                if e.uri != opened:
                    if raw is not None:
                        raw.close()
                    fs, path = _fs_and_path(e.uri)
                    raw, opened = fs.open_input_file(path), e.uri
                try:
                    data = _read_entry(raw, e.at, e.packed, e.size, e.crc, e.method, e.encrypted)
                except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, ValueError, NotImplementedError, RuntimeError,
                        EOFError) as err:
                    rows.append((e.scan_id, e.path, e.size, None, str(err)))
                    continue
                except OSError as err:
                    if e.method != zipfile.ZIP_BZIP2:  # bz2 reports broken data so; else the store failed and the task is tried again
                        raise
                    rows.append((e.scan_id, e.path, e.size, None, str(err)))
                    continue
                rows.append((e.scan_id, e.path, e.size, _text(data), None))
                held += len(data)
                if held >= EMIT_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)
    finally:
        if raw is not None:
            raw.close()


def entry_spans(spark: SparkSession, glob_path: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """One row per entry of the archives: where its bytes are, and its span."""
    listed = spark.read.format("binaryFile").load(glob_path).select(
        F.col("path").alias("uri"), "length", F.regexp_extract("path", r"([^/]+?)(\.zip)?$", 1).alias("scan_id"))
    return listed.mapInPandas(_directories(span_bytes), _ENTRY)


def archive_rows(spark: SparkSession, glob_path: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(scan_id, path, size, content, error) of every entry; an archive that is none has
    a row without a path, an entry that cannot be read (broken, encrypted, of an
    unknown method, over 2 GB) one with an error.  Empty entries have an empty
    content, binary ones none; equal names in an archive give a row each."""
    listed = spark.read.format("binaryFile").load(glob_path)
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1), MAX_TASKS)
    dealt = entry_spans(spark, glob_path, span_bytes).repartition(tasks, "uri", "span").sortWithinPartitions("uri", "at")
    return dealt.mapInPandas(_contents, _ROW)
