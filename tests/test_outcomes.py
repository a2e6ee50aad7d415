"""Every rule of these queries both holds and fails somewhere in the tables."""

import pytest

from codelens.plans import bindings as V
from codelens.plans import q_detect, q_diff, q_joins

SF = "/root/testdata/sf0.01"


def test_some_scans_have_a_name_and_some_lack_it(spark):
    for view, names in ((V.v_configs, V.CONFIG_NAMES), (V.v_frameworks, V.FRAMEWORK_NAMES), (V.v_packages, V.PACKAGE_NAMES)):
        pairs = {(r.scan_id, r.name) for r in view(spark, SF).select("scan_id", "name").collect()}
        times = {n: sum((s, n) in pairs for s in V.SCANS) for n in names}
        assert {0 < t < 3 for t in times.values()} >= {True} and len(pairs) > len(names)
    assert {1, 2} & {sum((s, "Next.js") in {(r.scan_id, r.name) for r in V.v_frameworks(spark, SF).collect()} for s in V.SCANS)}


def test_every_part_counts(spark):
    parts = V.table(spark, SF, "part")
    every = V._named(parts, [f"n{i}" for i in range(3)])
    left_out = {(s, n) for s in V.SCANS for n in ("n0", "n1", "n2")} - {(r.scan_id, r.name) for r in every.select("scan_id", "name").distinct().collect()}
    assert parts.count() - every.count() == sum(
        (V.SCANS[r.p_partkey % 3], f"n{r.p_partkey // 3 % 3}") in left_out for r in parts.select("p_partkey").collect())


def test_allow_list(spark):
    frameworks = {tuple(r) for r in V.v_frameworks(spark, SF).collect()}
    kept = {tuple(r) for r in q_joins.q_join12(spark, SF).collect()}
    assert kept and kept < frameworks
    assert {f for f in frameworks if f[0] == V.SCANS[-1]} <= kept


def test_framework_versions(spark):
    assert {r.version == "" for r in q_joins.q_join06(spark, SF).collect()} == {True, False}


def test_router(spark):
    scores = q_diff.router(spark, SF).collect()
    assert {r.grp for r in scores} == {"frameworks", "languages", "ml"}
    assert {"TypeScript", "JavaScript", "Python", "PyTorch", "Scikit-learn", "Express", "Angular"} <= {r.name for r in scores}
    assert len({r["rank"] for r in q_diff.q_win01(spark, SF).collect()}) > 2
    assert {r.allowed for r in q_diff.q_win02(spark, SF).collect()} == {True, False}
    order = {}
    for r in q_diff.q_win03(spark, SF).collect():
        order.setdefault(r.scan_id, {})[r.position] = r.name
    names = [[n for _p, n in sorted(o.items())] for o in order.values()]
    assert any(n != sorted(n) for n in names)


@pytest.mark.parametrize("query", [q_joins.q_join12, q_joins.q_join13, q_joins.q_join14, q_detect.q_det31])
def test_not_empty(spark, query):
    assert query(spark, SF).limit(1).count() == 1


def test_literals_of_sql(spark):
    from codelens.dims import literal_array, sql_text
    values = ["a'b", 'c"d', "e\\f", "\\n", "g\nh", "${user}", "$1", "`", "é\t", "", "%s {x}", "\\u0041"]
    assert spark.range(1).select(literal_array(values).alias("v")).first().v == values
    assert spark.sql(f"SELECT {sql_text(None)} IS NULL AS x").first().x


def test_snapshots_compare_any_two_scans(spark):
    from codelens.operators import diff as D
    rows = [("a", "f", "x", "supported"), ("a", "f", "y", None), ("b", "f", "x", "partial"), ("c", "f", "y", "partial"), ("c", "g", "x", "supported"),
            ("d", "f", "x", "supported"), ("b", "f", "x", "partial")]
    base = spark.createDataFrame(rows, "scan_id string, file string, feature string, status string")
    scans = ["a", "b", "c"]
    frame = D.snapshots(base, scans)
    assert {(r.file, r.feature): r.present for r in frame.collect()} == {("f", "x"): 3, ("f", "y"): 5, ("g", "x"): 4}
    for a, b in (("a", "b"), ("b", "c"), ("c", "a")):
        assert sorted(map(tuple, D.pair(frame, scans, a, b).collect())) == sorted(map(tuple, D.pair_features(base, a, b).collect()))
    sugg = spark.createDataFrame([("a", "1", "f", "t"), ("a", None, "f", "t"), ("c", "1", "f", "t"), ("c", "2", "f", "t"), ("c", "2", "g", "u")],
                                 "scan_id string, id string, file string, title string")
    assert tuple(D.diff_summary(base, sugg, "a", "c").first()) == (1, 1, 1, 2, 1)
    assert tuple(D.diff_summary(base, sugg, "a", "a").first()) == (0, 0, 0, 0, 0)
    p = D.diff_summary(base, sugg, "a", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("LogicalRDD") + p.count("LocalRelation") == 2
