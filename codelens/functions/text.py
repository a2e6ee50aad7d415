"""Text helpers shared by detectors and search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word boundaries.  Spark's ``\b`` is Unicode-aware on Java 17 while the
# scanned application's regexes are ASCII, so patterns spell them out.
_B = "(^|[^A-Za-z0-9_$])"
_A = "([^A-Za-z0-9_$]|$)"


def word_pattern(word: str) -> str:
    return _B + re.escape(word) + _A


def tokenize(c: Column) -> Column:
    """lower, characters outside ``[a-z0-9_\\-\\s]`` -> space, split on
    whitespace, keep tokens longer than one character."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_\-\s]", " ")
    parts = F.split(F.trim(cleaned), r"\s+")
    return F.filter(parts, lambda t: F.length(t) > 1)
