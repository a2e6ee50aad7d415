"""Baseline status vocabulary (JOIN-04, AGG-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelens.rules import IMPACT_RANK, IMPACT_RANK_DEFAULT, STATUS_BY_RANK, STATUS_RANK_WORDS


def status_rank(c: Column) -> Column:
    """unsupported/no/n -> 3, partial/a -> 2, supported/yes/y -> 1, else 0."""
    v = F.lower(F.trim(c.cast("string")))
    out = F.lit(0)
    for rank in (1, 2, 3):  # later `when` wraps earlier ones: highest rank checked first
        out = F.when(v.isin(*STATUS_RANK_WORDS[rank]), F.lit(rank)).otherwise(out)
    return out


def status_from_rank(r: Column) -> Column:
    out = F.lit(STATUS_BY_RANK[0])
    for rank in (1, 2, 3):
        out = F.when(r == rank, F.lit(STATUS_BY_RANK[rank])).otherwise(out)
    return out


def worst_status(support: Column) -> Column:
    """Worst status over a MAP<browser, support> column."""
    return worst_of(F.map_values(support))


def worst_of(values: Column) -> Column:
    """Worst status over an ARRAY<support> column (empty/NULL -> unknown)."""
    worst = F.coalesce(F.array_max(F.transform(values, status_rank)), F.lit(0))
    return status_from_rank(worst)


def impact_rank(status: Column) -> Column:
    """Impact weight of one baseline entry: unsupported 3, partial 2, any other 1."""
    v = F.lower(F.coalesce(status.cast("string"), F.lit("unknown")))
    out = F.lit(IMPACT_RANK_DEFAULT)
    for word, w in IMPACT_RANK.items():
        out = F.when(v == word, F.lit(w)).otherwise(out)
    return out
