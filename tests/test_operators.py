"""Hand-made cases for joins, windows, scores and text helpers (one case per
rule / quirk, expected values worked out from the scanned application's code)."""

import datetime as dt

from pyspark.sql import functions as F

from codelens import dims
from codelens.operators import joins as J
from codelens.operators import score as S
from codelens.operators import text as X
from codelens.operators import topk as T
from codelens.operators import window as W
from codelens.sources import manifests as M
from scan_files import files_df


def test_allow_list_and_bypass(spark):
    fw = spark.createDataFrame([("s1", "Vue"), ("s1", "React"), ("s2", "Vue")], "scan_id string, name string")
    allow = spark.createDataFrame([("s1", "Vue")], "scan_id string, name string")
    got = sorted(map(tuple, J.apply_allow_list(fw, allow, True).collect()))
    assert got == [("s1", "Vue"), ("s2", "Vue")]          # s2 has no list -> pass-through
    assert J.apply_allow_list(fw, allow, False).count() == 3


def test_tech_gate(spark):
    tech = spark.createDataFrame([("Vue", True, "active", "smoke"), ("Old", True, "inactive", "x"),
                                  ("Beta", False, "active", "thorough")],
                                 "name string, approved boolean, status string, testing_level string")
    fw = spark.createDataFrame([("s", "Vue"), ("s", "Old"), ("s", "Beta"), ("s", "Unknown")], "scan_id string, name string")
    plain = {r.name: r.testing_level for r in J.apply_tech_gate(fw, tech, enforce=False).collect()}
    assert plain == {"Vue": "smoke", "Beta": "thorough", "Unknown": "smoke"}
    strict = {r.name for r in J.apply_tech_gate(fw, tech, enforce=True).collect()}
    assert strict == {"Vue", "Unknown"}
    assert dims.tech_dim(spark).count() == 10


def test_missing_configs_and_changed(spark):
    feats = spark.createDataFrame([("s", "a", "TypeScript"), ("t", "b", "fetch")], "scan_id string, file string, feature string")
    cfg = spark.createDataFrame([("s", "babel.config.js")], "scan_id string, name string")
    got = sorted(map(tuple, J.missing_configs(cfg, feats, feats.select("scan_id")).collect()))
    assert got == [("s", ".browserslistrc"), ("s", "postcss.config.js"), ("s", "tsconfig.json"),
                   ("t", ".browserslistrc"), ("t", "babel.config.js"), ("t", "postcss.config.js")]


def test_remediation_first_rule_wins(spark):
    f = spark.createDataFrame([("s", "Permissive CORS with credentials"), ("s", "CSP"), ("s", "Other")], "scan_id string, title string")
    got = [(r.title, r.snippet) for r in J.remediation(f).collect()]
    assert got == [("Permissive CORS with credentials", "corsRestrict"), ("CSP", "helmetCsp"), ("Other", None)]


def test_latest_snapshot_and_merge_section(spark):
    stored = spark.createDataFrame([("a", "done")], "id string, status string")
    live = spark.createDataFrame([("a", "processing"), ("b", "queued")], "id string, status string")
    got = sorted((r.id, r.status) for r in J.latest_snapshot(stored, live, "id").collect())
    assert got == [("a", "done"), ("b", "queued")]
    base = spark.createDataFrame([("s", []), ("t", ["Vue"])], "scan_id string, ui array<string>")
    derived = spark.createDataFrame([("s", ["React"]), ("t", ["X"])], "scan_id string, ui array<string>")
    got = {r.scan_id: r.ui for r in J.merge_section(base, derived, None, "scan_id", "ui").collect()}
    assert got == {"s": ["React"], "t": ["Vue"]}


def test_router_threshold_and_rank(spark):
    sc = spark.createDataFrame([("s", "frameworks", "Vue", 4), ("s", "frameworks", "Nuxt", 4), ("s", "frameworks", "Nx", 1),
                                ("s", "frameworks", "Angular", 0)], "scan_id string, grp string, name string, score long")
    ranks = {r.name: r.rank for r in W.rank_router(sc).collect()}
    assert ranks == {"Nuxt": 1, "Vue": 2, "Nx": 3}                 # ties in the fixed name order
    allowed = {r.name: r.allowed for r in W.allow_threshold(sc, 0.5).collect()}
    assert allowed == {"Vue": True, "Nuxt": True, "Nx": False}     # threshold max(1, floor(4*0.5)) = 2
    assert {r.name for r in W.allow_threshold(sc, 7).collect() if r.allowed} == {"Vue", "Nuxt"}  # pct clamped to 1


def test_retention(spark):
    t0 = dt.datetime(2024, 1, 10)
    e = spark.createDataFrame([("r", "a", 40, t0), ("r", "b", 40, t0 - dt.timedelta(days=1)),
                               ("r", "c", 40, t0 - dt.timedelta(days=2)), ("r", "d", 10, t0 - dt.timedelta(days=30))],
                              "root string, path string, size long, mtime timestamp")
    got = {r.path: r.action for r in W.retention(e, "2024-01-10 00:00:00", 7 * 86400, 80).collect()}
    assert got == {"a": "keep", "b": "keep", "c": "evict", "d": "expire"}


def test_file_tree(spark):
    f = files_df(spark, [("README.md", ""), ("src/a.js", ""), ("src/lib/deep/b.js", ""), ("src/lib/c.js", ""), ("docs/x.md", "")])
    nodes = sorted((r.parent, r.name, r.type) for r in S.file_tree(f, 2, 300).collect())
    assert nodes == sorted([("", "README.md", "file"), ("", "src", "dir"), ("src", "a.js", "file"), ("src", "lib", "dir"),
                            ("src/lib", "b.js", "file"), ("src/lib", "c.js", "file"), ("", "docs", "dir"), ("docs", "x.md", "file")])
    capped = S.file_tree(f, 2, 4).count()
    assert capped == 3                                              # root + 3 nodes


def test_impact_heatmap_and_percentages(spark):
    s = spark.createDataFrame([("s", "a.js", "High", "secure"), ("s", "a.js", "low", "other"), ("s", "b.js", None, "performance")],
                              "scan_id string, file string, severity string, category string")
    got = {r.file: (r.score, r.pct, r.categories) for r in S.impact_heatmap(s).collect()}
    assert got["a.js"] == (4.9, 100, "other,secure") and got["b.js"] == (1.2, 24, "performance")


def test_sanitize_and_generate(spark):
    s = spark.createDataFrame([("s", 1, None, "t", "please rm -rf /", "High", "secure", None, None, None),
                               ("s", 2, "id2", "t2", "x" * 500, "Critical", "weird", "", "p" * 3000, "h")],
                              "scan_id string, ord int, id string, title string, description string, severity string, "
                              "category string, file string, patch string, hint string")
    got = X.sanitize_suggestions(s).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.id, r.severity, r.category, r.file, len(r.description), len(r.patch)) == ("id2", "Medium", "modernize", "README.md", 400, 2000)


def test_snippet_and_search(spark):
    text = "line one\nsecond Token here\nthird\nfourth\nfifth\nsixth"
    df = spark.createDataFrame([("s", "a.md", text), ("s", "b.md", "no match")], "scan_id string, path string, content string")
    r = X.search_files(df, "token TOKEN", 10).collect()
    assert len(r) == 1 and r[0].score == 2 and (r[0].start_line, r[0].end_line, r[0].match_line) == (1, 4, 2)
    assert r[0].snippet == "line one\nsecond Token here\nthird\nfourth"


def test_read_manifests_and_versions(spark):
    f = files_df(spark, [("package.json", '{"dependencies": {"react": "18", "next": "14"}, "devDependencies": {"react": "18"}}'),
                         ("web/package.json", '{"dependencies": {"react": "17"}}'),
                         ("node_modules/x/package.json", '{"dependencies": {"evil": "1"}}'),
                         ("broken/package.json", "{not json")])
    deps = M.read_manifests(f)
    got = sorted((r.package_dir, r.name, r.version, r.dev) for r in deps.collect())
    assert got == [(".", "next", "14", False), (".", "react", "18", False), (".", "react", "18", True), ("web", "react", "17", False)]
    fw = spark.createDataFrame([("s1", "React"), ("s1", "Next.js"), ("s1", "Vue")], "scan_id string, name string")
    pk = spark.createDataFrame(J.FRAMEWORK_PACKAGES, "framework string, package string")
    inv = deps.withColumn("ord", F.when(F.col("package_dir") == ".", 0).otherwise(1))
    got = {r.framework: r.version for r in J.framework_versions(fw, inv, pk).collect()}
    assert got == {"React": "18", "Next.js": "14", "Vue": ""}


def test_page_and_top_k(spark):
    df = spark.createDataFrame([("s", i) for i in range(25)], "scan_id string, ord int")
    p = T.page(df, 3, 10, [F.col("ord")], by=["scan_id"]).collect()
    assert sorted(r.ord for r in p) == [20, 21, 22, 23, 24] and {r.total_pages for r in p} == {3}


def test_distributed_running_sum_matches_window(spark):
    import random
    from pyspark.sql import Window
    from codelens.operators.ordered import row_index, running_sum
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", i, rnd.randint(-5, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ord int, v int")
    got = {(r.key, r.ord): r.running for r in running_sum(df, ["key"], ["ord"], F.col("v"), "running", 13).collect()}
    w = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {(r.key, r.ord): float(r.s) for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    assert got == want
    desc = {(r.key, r.ord): r.row for r in row_index(df, ["key"], ["-ord"], "row").collect()}
    w2 = Window.partitionBy("key").orderBy(F.col("ord").desc())
    assert desc == {(r.key, r.ord): r.n for r in df.withColumn("n", F.row_number().over(w2)).collect()}


def test_commit_frequency_and_log_levels(spark):
    t = dt.datetime(2024, 1, 1)
    act = spark.createDataFrame([("r1", t + dt.timedelta(weeks=i), n) for i, n in enumerate([1, 2, 3, 4, 9])] +
                                [("r2", t, 3)], "repo string, week timestamp, total long")
    con = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r1", "a"), ("r2", "c")], "repo string, login string")
    got = {r.repo: (r.commits_per_week, r.contributors) for r in S.commit_frequency(act, con).collect()}
    assert got == {"r1": (5, 2), "r2": (3, 1)}          # last 4 weeks 2+3+4+9 -> 4.5 -> 5; fewer than 4 weeks: mean of those
    logs = spark.createDataFrame([("s", "Scan failed"), ("s", "WARN: slow"), ("s", "Done"), ("s", "started"), ("s", None)],
                                 "scan_id string, msg string")
    got = {r.level: r.lines for r in S.log_levels(logs).collect()}
    assert got == {"error": 1, "warn": 1, "success": 1, "info": 2}


def test_time_helpers(spark):
    from codelens import functions as FN
    df = spark.createDataFrame([("1704067200000", 59.4), ("2024-01-01T00:00:00.000Z", 61.5), ("not a date", 0.0)],
                               "t string, secs double")
    got = [(r.p, r.d) for r in df.select(FN.parse_time(F.col("t")).alias("p"), FN.duration_text(F.col("secs")).alias("d")).collect()]
    assert got[0][0] == dt.datetime(2024, 1, 1) and got[1][0] == dt.datetime(2024, 1, 1) and got[2][0] is None
    assert [d for _, d in got] == ["59s", "1m 2s", "0s"]


def test_retention_rules_off(spark):
    t0 = dt.datetime(2024, 1, 10)
    e = spark.createDataFrame([("r", "a", 40, t0), ("r", "b", 40, t0 - dt.timedelta(days=300))],
                              "root string, path string, size long, mtime timestamp")
    assert {r.action for r in W.retention(e, "2024-01-10 00:00:00", 0, 0).collect()} == {"keep"}
