"""Plan-shape guards for the scale properties the README claims: no cartesian
or nested-loop joins and no row-at-a-time Python UDFs anywhere; per-scan top-k
limited before the shuffle; per-file detectors without any shuffle."""

import re

SF = "/root/testdata/sf0.001"
SIDE_EFFECTS = {"SRC-01", "SRC-08", "SRC-14", "SRC-15", "STR-09", "STR-11"}  # write scratch files when built


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_no_python_udf(spark):
    import __spark_entry__ as E
    bad = {}
    for name, fn in sorted(E.queries().items()):
        if name in SIDE_EFFECTS:
            continue
        p = plan(fn(spark, SF))
        flags = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if k in p]
        if flags:
            bad[name] = flags
    assert bad == {}


def test_top_k_is_limited_before_shuffle(spark):
    import __spark_entry__ as E
    for name in ("TOP-01", "TOP-02", "TOP-04", "TOP-06", "TOP-07", "WIN-05"):
        p = plan(E.queries()[name](spark, SF))
        assert re.search(r"WindowGroupLimit .*Partial", p), name


def test_per_file_detectors_do_not_shuffle(spark):
    import __spark_entry__ as E
    for name in ("DET-01", "DET-02", "DET-17", "DET-18", "DET-27", "TXT-01", "TXT-05", "SRC-02", "SRC-07"):
        p = plan(E.queries()[name](spark, SF))
        assert "Exchange" not in p, name


def test_literal_dims_are_broadcast(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["JOIN-01"](spark, SF))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
