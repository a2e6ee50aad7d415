"""Math, string, path, date and null helpers (FN-01..08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """Round like ``Math.round``: half up toward +inf (Spark's ``round`` is half away from 0)."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def first_truthy(*cols: Column) -> Column:
    """``a || b || c``: skip NULL, empty string and numeric zero."""
    cleaned = []
    for c in cols:
        s = c.cast("string")
        cleaned.append(F.when(s.isNull() | (s == "") | (s == "0") | (s == "false"), None).otherwise(c))
    return F.coalesce(*cleaned)


def _norm(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(_norm(path), "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a relative path; ``.`` for a root-level file."""
    p = _norm(path)
    return F.when(p.contains("/"), F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def ext(path: Column) -> Column:
    """Lower-case extension with the dot (``.js``); ``''`` when there is none.

    Like ``path.extname``: a leading dot of the basename does not start an
    extension (``.gitignore`` has none).
    """
    b = basename(path)
    return F.lower(F.regexp_extract(b, r"^.+(\.[^.]*)$", 1))


def hash_key(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def parse_time(c: Column) -> Column:
    """Epoch millis (numeric) or ISO text -> TIMESTAMP; NULL when unparsable."""
    s = c.cast("string")
    return F.when(s.rlike(r"^[0-9]{10,}$"), F.timestamp_millis(s.cast("long"))).otherwise(
        F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))))


def duration_text(seconds: Column) -> Column:
    """``'<m>m <s>s'`` when at least a minute, else ``'<s>s'`` (rounded seconds)."""
    total = round_half_up(seconds).cast("long")
    mins = F.floor(total / 60).cast("long")
    secs = (total % 60).cast("long")
    return F.when(mins > 0, F.format_string("%dm %ds", mins, secs)).otherwise(F.format_string("%ds", secs))


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``: strips all leading/trailing whitespace
    (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")
