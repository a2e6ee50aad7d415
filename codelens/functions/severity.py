"""Severity vocabulary.

Producers use different words (``critical/high/moderate/medium/low``,
``ERROR/WARNING/INFO``, ``High/Medium/Low``).  ``normalize_severity`` folds
them into one lower-case enum once at ingest (``moderate`` == ``medium``);
the other helpers are the weights and buckets the reports use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_severity(c: Column) -> Column:
    """critical / high / medium (also moderate) / low / unknown."""
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s.contains("critical"), "critical")
            .when(s.startswith("high"), "high")
            .when(s.startswith("medium") | s.startswith("moderate"), "medium")
            .when(s.startswith("low"), "low")
            .otherwise("unknown"))


def severity_weight(c: Column) -> Column:
    """Sort weight for top-k: critical 4, high 3, medium 2, low 1, else 0."""
    s = normalize_severity(c)
    return (F.when(s == "critical", 4).when(s == "high", 3)
            .when(s == "medium", 2).when(s == "low", 1).otherwise(0))


def severity_rank3(c: Column) -> Column:
    """Issue sort weight: High 3, Medium 2, anything else 1."""
    s = normalize_severity(c)
    return F.when(s.isin("critical", "high"), 3).when(s == "medium", 2).otherwise(1)


def severity_bucket(c: Column, default: str = "low") -> Column:
    """Four buckets (critical/high/medium/low); missing or unknown -> ``default``."""
    s = normalize_severity(F.coalesce(c.cast("string"), F.lit(default)))
    return F.when(s == "unknown", F.lit(default)).otherwise(s)


def semgrep_severity(c: Column) -> Column:
    """error/high/critical -> High, warning/medium -> Medium, else Low."""
    s = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return (F.when(s.contains("error") | s.contains("high") | s.contains("critical"), "High")
            .when(s.contains("warning") | s.contains("medium"), "Medium")
            .otherwise("Low"))
