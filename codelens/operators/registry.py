"""Detector registry (UDF-01) and the sample detector (UDF-02).

A detector is a Python function ``Tables -> dict[str, DataFrame]`` that
receives the scan tables built so far and returns tables to add or replace.
Detectors run in registration order, each seeing the previous results.  As in
the original, a failing detector is logged and skipped — with Spark's lazy
evaluation that covers plan construction / analysis errors (raised while the
detector builds its DataFrames); errors in the data surface at the action that
materialises the result, like any other Spark job.

Log lines are kept as a small DataFrame ``logs(scan_id, ts, msg)`` per run
(one line per detector, not per row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
Detector = Callable[[Tables], Tables]

_REGISTRY: list[tuple[str, Detector]] = []


def register(name: str, fn: Detector | None = None):
    """Register ``fn`` under ``name`` (usable as a decorator)."""
    def deco(f: Detector) -> Detector:
        _REGISTRY[:] = [(n, g) for n, g in _REGISTRY if n != name]
        _REGISTRY.append((name, f))
        return f
    return deco(fn) if fn is not None else deco


def registered() -> list[str]:
    return [n for n, _ in _REGISTRY]


def run_detectors(spark: SparkSession, tables: Tables, detectors: list[tuple[str, Detector]] | None = None,
                  analyze: bool = True) -> tuple[Tables, list[str]]:
    """Apply detectors in order; returns the updated tables and the log.

    With ``analyze=True`` each returned DataFrame's schema is resolved inside
    the try block, so an invalid plan is caught and the detector skipped."""
    results = dict(tables)
    log: list[str] = []
    for name, fn in (detectors if detectors is not None else list(_REGISTRY)):
        try:
            out = fn(dict(results)) or {}
            if analyze:
                for df in out.values():
                    df.schema  # noqa: B018 - forces analysis
            results.update(out)
            log.append(f"[plugin] Executed {name}")
        except Exception as e:  # noqa: BLE001 - a failing detector is skipped
            log.append(f"[plugin] Error in {name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
    return results, log


def sample_detector(tables: Tables) -> Tables:
    """UDF-02: scans with files under ``.github/workflows`` get the project
    feature ``GitHub Actions``; scans with ``docker-compose.yml`` or
    ``Dockerfile`` among their config files get the framework ``Docker``."""
    files = tables["files"]
    p = F.regexp_replace("path", r"\\", "/")
    gha = files.filter(p.rlike(r"(^|/)\.github/workflows/")).select("scan_id").distinct()
    out: Tables = {}
    feats = gha.select("scan_id", F.lit("GitHub Actions").alias("feature"))
    if "project_features" in tables:
        out["project_features"] = tables["project_features"].select("scan_id", "feature").unionByName(feats).distinct()
    else:
        out["project_features"] = feats
    if "configs" in tables:
        docker = (tables["configs"].filter(F.col("name").isin("docker-compose.yml", "Dockerfile"))
                  .select("scan_id").distinct().select("scan_id", F.lit("Docker").alias("name")))
        base = tables.get("frameworks")
        out["frameworks"] = docker if base is None else base.select("scan_id", "name").unionByName(docker).distinct()
    return out


register("sample-detector", sample_detector)
