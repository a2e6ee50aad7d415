"""Deployment helpers: cluster sizing and shipping the package to workers."""

import zipfile

from codelens.session import ensure_checkpoint_dir, scale_conf, ship_package


def test_scale_conf():
    big = scale_conf(100 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 24000           # 3 waves; a twentieth of 100 TB / 256 MB is less
    assert int(scale_conf(100 * 1024 ** 4, 100)["spark.sql.shuffle.partitions"]) == 20480
    small = scale_conf(1024 ** 3, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 192           # at least 3 waves per core
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_ship_package_is_idempotent_and_importable(spark):
    first = ship_package(spark)
    assert ship_package(spark) == first
    assert first.startswith(ensure_checkpoint_dir(spark).rstrip("/"))
    path = first.split(":", 1)[1] if first.startswith("file:") else first
    names = zipfile.ZipFile(path).namelist()
    assert "codelens/__init__.py" in names and "codelens/operators/detect.py" in names
