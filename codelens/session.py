"""Spark session helpers.

The library never creates a session behind the caller's back: operators take
DataFrames.  These helpers exist for tests, the bench and the driver contract.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at every scale.  Shuffle partitions is sized by the
# caller (cores locally, ~2-3x total executor cores on a cluster); AQE then
# coalesces small partitions and splits skewed ones at runtime.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Auto-broadcast stays at Spark's default threshold (10 MB): only dims of
    # a proven small size are hinted explicitly with F.broadcast.
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "codelens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (HDFS/S3/...) folder and is used
    as is.  Only when it is unset in local mode (tests) a fresh scratch folder
    is created and set; on a cluster, where a local folder would be another one
    on every machine, an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = sc.master or ""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="codelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # static conf on some deployments; the context holds it
        pass
    return local


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 * 1024 * 1024,
               max_split_bytes: int = 256 * 1024 * 1024, shuffle_share: float = 0.05) -> dict:
    """Settings for a corpus of ``input_bytes`` on ``total_cores`` executor
    cores, derived without touching the data.

    - shuffle partitions: enough that one partition of the largest shuffle
      (``shuffle_share`` of the input: findings and counts travel, file contents
      do not) is ~``target_partition_bytes``, and at least 3 waves of tasks per
      core; AQE coalesces the small ones.  100 TB give some 20,000 partitions,
      whose map-output state a driver can hold;
    - ``maxPartitionBytes``: parquet / binaryFile splits of at most 256 MB;
    - AQE advisory size and skew thresholds matched to the target, so a scan
      holding a third of all rows is split rather than run as one task.
    """
    parts = max(3 * total_cores, -(-int(input_bytes * shuffle_share) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
    }


def ship_package(spark: SparkSession) -> str | None:
    """Make ``codelens`` importable on every Python worker: zip the package,
    put the zip in the shared checkpoint folder and ``addPyFile`` it (once per
    SparkContext).  Functions given to ``mapInPandas`` / ``applyInPandas`` are
    pickled by module reference, so executors must be able to import them."""
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_codelens_shipped", None):
        return sc._codelens_shipped
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in sorted(os.walk(pkg_dir)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    data = buf.getvalue()
    target = ensure_checkpoint_dir(spark).rstrip("/") + f"/codelens-pkg-{hashlib.md5(data).hexdigest()[:12]}.zip"
    from codelens.sources.corpus import _fs_and_path
    fs, path = _fs_and_path(target)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)
    sc.addPyFile(target)
    sc._codelens_shipped = target
    return target
