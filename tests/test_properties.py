"""Properties from SURVEY §5: diff(a,a) is empty, diff(a,b).added ==
diff(b,a).removed, sum of per-file impact == sum of ranks, 0 <= risk <= 100,
redaction is idempotent, upsert twice == once; plus baseline fixtures."""

from pyspark.sql import functions as F

from codelens import dims
from codelens.operators import baseline as B
from codelens.operators import diff as D
from codelens.operators import score as S
from codelens.operators import text as X
from codelens.plans import bindings as V
from codelens.sources import sinks as K

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_diff_self_is_empty(spark):
    b = V.v_baseline(spark, SF)
    assert D.diff_features(b, "A", "A").count() == 0
    assert D.diff_status(b, "A", "A").count() == 0
    assert D.diff_status_counts(b, "A", "A").first().asDict() == {"supported": 0, "partial": 0, "unsupported": 0, "unknown": 0}


def test_diff_is_antisymmetric(spark):
    b = V.v_baseline(spark, SF)
    ab = D.diff_features(b, "A", "R")
    ba = D.diff_features(b, "R", "A")
    assert rows(ab.filter("change = 'added'").drop("change")) == rows(ba.filter("change = 'removed'").drop("change"))
    s = V.v_suggestions(spark, SF)
    sab = D.diff_suggestions(s, "A", "R")
    sba = D.diff_suggestions(s, "R", "A")
    assert sab.filter("change = 'added'").count() == sba.filter("change = 'removed'").count()


def test_impact_sum_equals_rank_sum(spark):
    base = B.lookup_baseline(V.v_features(spark, SF), dims.feature_dim(spark))
    total = S.impact_by_file(base).agg(F.sum("score")).first()[0]
    ranks = base.select(F.when(F.col("status") == "unsupported", 3).when(F.col("status") == "partial", 2)
                        .otherwise(1).alias("r")).agg(F.sum("r")).first()[0]
    assert total == ranks


def test_risk_is_bounded(spark):
    import __spark_entry__ as E
    for r in E.queries()["AGG-18"](spark, SF).collect():
        assert 0 <= r.risk <= 100


def test_redact_idempotent_and_counts(spark):
    df = spark.createDataFrame([(1, 'token = "abc123" and Bearer xyz.1 ghp_' + "a" * 22 + " AWS_KEY=zz password: hunter2"),
                                (2, "nothing here")], "id int, t string")
    once = X.redact(df, "t")
    twice = X.redact(once.select("id", F.col("redacted").alias("t")), "t")
    r1 = {r.id: (r.redacted, r.redactions) for r in once.collect()}
    r2 = {r.id: (r.redacted, r.redactions) for r in twice.collect()}
    assert r1[1][1] == 5 and r1[2] == ("nothing here", 0)
    assert {k: v[0] for k, v in r1.items()} == {k: v[0] for k, v in r2.items()}
    assert r2[1][1] == 0


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([("a", "queued"), ("b", "done")], "id string, status string")
    u = spark.createDataFrame([("a", "processing"), ("c", "queued")], "id string, status string")
    once = K.upsert(t, u, "id", ts_col=None)
    twice = K.upsert(once, u, "id", ts_col=None)
    assert rows(once) == rows(twice) == [("a", "processing"), ("b", "done"), ("c", "queued")]
    assert rows(K.delete_scans(once, spark.createDataFrame([("b",)], "id string"), "id")) == [("a", "processing"), ("c", "queued")]


def test_lookup_baseline_fixture(spark):
    feats = spark.createDataFrame([("s", "a.js", "fetch"), ("s", "a.js", "ResizeObserver"), ("s", "b.js", "css-nesting"),
                                   ("s", "b.js", "perb")], "scan_id string, file string, feature string")
    dim = dims.feature_dim(spark).unionByName(spark.createDataFrame(
        [("perb", "chrome", "yes", "mapping", ""), ("perb", "safari", "n", "mapping", ""), ("perb", "firefox", "a", "mapping", "")],
        "feature string, browser string, support string, source string, notes string"))
    got = {r.feature: (r.status, r.support["edge"], r.notes) for r in B.lookup_baseline(feats, dim).collect()}
    assert got["fetch"] == ("supported", "supported", "")
    assert got["ResizeObserver"] == ("partial", "partial", "")
    assert got["css-nesting"] == ("unknown", "unknown", B.UNMAPPED_NOTE)
    assert got["perb"][0] == "unsupported" and got["perb"][1] == "unknown"


def test_compat_and_web_features_fallbacks(spark):
    feats = spark.createDataFrame([("s", "a.js", "css-nesting"), ("s", "a.js", "top-level-await"), ("s", "a.js", "weird")],
                                  "scan_id string, file string, feature string")
    base = B.lookup_baseline(feats, dims.feature_dim(spark))
    entry = "array<struct<version_added:string,partial_implementation:boolean,flags:boolean,prefix:string,alternative_name:string>>"
    compat = spark.createDataFrame([
        ("css.selectors.nesting", "chrome", [("112", None, None, None, None)]),
        ("css.selectors.nesting", "safari", [("16", True, None, None, None)]),
        ("css.selectors.nesting", "firefox", [("100", None, None, None, None), (None, None, None, None, None)]),
        ("css.selectors.nesting", "edge", [("112", None, None, None, None)])],
        f"path string, browser string, entries {entry}")
    c = B.lookup_compat(base, dims.compat_aliases(spark), compat)
    got = {r.feature: (r.status, r.support["safari"], r.support["firefox"]) for r in c.collect()}
    assert got["css-nesting"] == ("unsupported", "partial", "unsupported")  # last firefox entry has no version
    assert got["top-level-await"][0] == "unknown"
    wf = spark.createDataFrame([(1, "Weirdness API", "weirdness", {"chrome": "supported", "safari": "partial"}),
                                (2, "Weird two", "weird-2", {"chrome": "no"})],
                               "ord int, name string, slug string, support map<string,string>")
    w = {r.feature: (r.status, r.notes) for r in B.lookup_web_features(c, wf).collect()}
    assert w["weird"] == ("partial", "Fallback from web-features for 'weirdness'")


def test_diff_roundtrip_text(spark):
    s = spark.createDataFrame([("s", 0, "a.txt", "x\ny", "x\nY", None), ("s", 1, "b.txt", "", "new", None),
                               ("s", 2, "c.txt", None, None, "--- a/c.txt\n+++ b/c.txt\n@@\n-old\n+new\n")],
                              "scan_id string, ord int, file string, original string, modified string, patch string")
    d = X.build_diff(s)
    parsed = {r.path: (r.original, r.modified) for r in X.parse_diffs(d, "diff", key="scan_id").collect()}
    assert parsed == {"a.txt": ("x\ny", "x\nY"), "b.txt": ("", "new"), "c.txt": ("old", "new")}
