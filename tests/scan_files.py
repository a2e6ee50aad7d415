"""Hand-made scan files for the detector tests."""

from codelens.operators.detect import with_path_cols


def files_df(spark, rows, scan="s1"):
    """rows: list of (path, content) or (path, content, size)."""
    data = []
    for r in rows:
        path, content = r[0], r[1]
        size = r[2] if len(r) > 2 else len(content or "")
        data.append((scan, path, size, content))
    return with_path_cols(spark.createDataFrame(data, "scan_id string, path string, size long, content string"))
