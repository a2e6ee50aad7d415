"""Sources on real temporary folders, tool readers, validation and
normalisation on hand-made rows."""

import base64
import io
import json
import os
import random
import re
import tempfile
import zipfile

from pyspark.sql import functions as F

from codelens.operators import text as X
from codelens.operators import validate as VA
from codelens.sources import archives as A
from codelens.sources import corpus as C
from codelens.sources import sinks as K
from codelens.sources import tools as TL


def _tree():
    root = tempfile.mkdtemp(prefix="tree-", dir="/tmp")
    files = {
        "src/a.js": "fetch('/x')\n", "src/deep/b.css": ".a{}", "node_modules/x/index.js": "x",
        ".gitignore": "build/\n*.log\n!keep.log\n", "build/out.js": "o", "app.log": "l", "keep.log": "k",
        ".gitattributes": "*.psd filter=lfs diff=lfs merge=lfs -text\nassets/** filter=lfs\n",
        "img/big.psd": "P", "assets/x/y.bin": "B", "bin/blob.dat": None,
        ".github/workflows/ci.yml": "on: push\n", "src/.env": "KEY=1",
    }
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(b"\x00\x01\x02" if text is None else text.encode())
    return root


def test_read_corpus_and_filters(spark):
    root = _tree()
    f = C.read_corpus(spark, root, "s1")
    paths = {r.path: r for r in f.collect()}
    assert paths["src/deep/b.css"].dir == "src/deep" and paths["src/deep/b.css"].ext == ".css"
    assert paths["bin/blob.dat"].content is None and paths["src/a.js"].content.startswith("fetch")
    assert {".gitignore", ".github/workflows/ci.yml", "src/.env"} <= set(paths)
    kept = {r.path for r in C.prune_dirs(f).collect()}
    assert "node_modules/x/index.js" not in kept and "src/a.js" in kept
    ign = {r.path for r in C.apply_ignore(f).collect()}
    assert "build/out.js" not in ign and "app.log" not in ign and "keep.log" in ign and "src/a.js" in ign
    lfs = {r.path for r in C.skip_lfs(f).collect()}
    assert "img/big.psd" not in lfs and "assets/x/y.bin" not in lfs and "src/a.js" in lfs
    assert {r.path for r in C.max_size(f, 2).collect()} <= {"img/big.psd", "assets/x/y.bin", "app.log", "keep.log",
                                                          "build/out.js", "node_modules/x/index.js", ".gitignore"}
    assert {r.path for r in C.exclude_paths(f, "src\\deep;build").collect()} & {"src/deep/b.css", "build/out.js"} == set()


def test_ignore_rules_against_plain_regular_expressions(spark):
    """Keyed joins give what every pattern tried on every path gives; the last match decides."""
    rnd = random.Random(3)
    names = ["a", "b", "lib", "x.log", "y.min.js", "foo1", "fob~", ".env", "z{1}+", "src"]
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(150)} | {"a//b", "/a", "x/", "n\u00e9.log"})
    globs = ["a", "lib/a", "/src", "b/", "*.log", "*.min.js", "fo*", "*~", "?", "**", "src/**/a", "a*b", "l?b/x.log", ".e*", "z{1}+", "*.js",
             "**/foo1", "/", "a/*", "lib/**", "f*1", "x.*", "a/b/lib"]
    texts = {s: [("!" if rnd.random() < 0.3 else "") + rnd.choice(globs) for _ in range(rnd.randint(1, 8))] for s in map(str, range(40))}
    texts.update({f"one{i}": [g] for i, g in enumerate(globs)})

    def regex(glob, below):
        out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in re.findall(r"\*\*|.", glob))
        return re.compile("(.*/)?" + out + ("(/.*)?" if below else ""), re.S)

    ignored, lfs = set(), set()
    for scan, lines in texts.items():
        for path in [*paths, ".gitignore", ".gitattributes"]:
            verdict = False
            for line in lines:
                if regex(re.sub("^/|/$", "", line.lstrip("!")), True).fullmatch(path):
                    verdict = not line.startswith("!")
            if verdict:
                ignored.add((scan, path))
            if any(regex(line.lstrip("!"), False).fullmatch(path) for line in lines):
                lfs.add((scan, path))
    rows = [(s, p, "") for s in texts for p in paths] + [(None, "a", ""), ("0", None, "")]
    rows += [(s, ".gitignore", "\n".join(["# rules", "", *lines])) for s, lines in texts.items()]
    rows += [(s, ".gitattributes", "\n".join(f"{x.lstrip('!')} filter=lfs -text" for x in lines)) for s, lines in texts.items()]
    files = spark.createDataFrame(rows, "scan_id string, path string, content string")
    every = [(s, p) for s, p, _ in rows]
    for kept, gone in ((C.apply_ignore(files), ignored), (C.skip_lfs(files), lfs)):
        assert sorted(map(str, [(r.scan_id, r.path) for r in kept.collect()])) == sorted(map(str, [k for k in every if k not in gone]))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_read_archives(spark):
    d = tempfile.mkdtemp(prefix="zips-", dir="/tmp")
    for name, entries in {"one.zip": {"a/x.js": "fetch()"}, "two.zip": {"b.css": ".a{}", "c/": None}}.items():
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for n, t in entries.items():
                if t is not None:
                    z.writestr(n, t)
        open(os.path.join(d, name), "wb").write(buf.getvalue())
    got = sorted((r.scan_id, r.path, r.ext, r.content) for r in C.read_archives(spark, d + "/*.zip").collect())
    assert got == [("one", "a/x.js", ".js", "fetch()"), ("two", "b.css", ".css", ".a{}")]


def test_json_any_encoding(spark):
    d = tempfile.mkdtemp(prefix="enc-", dir="/tmp")
    doc = json.dumps({"id": "x", "status": "done"})
    open(os.path.join(d, "a.json"), "wb").write(b"\xff\xfe" + doc.encode("utf-16-le"))
    open(os.path.join(d, "b.json"), "wb").write(b"\xfe\xff" + doc.encode("utf-16-be"))
    open(os.path.join(d, "c.json"), "wb").write(b"\xef\xbb\xbf" + doc.encode("utf-8"))
    got = [r.s for r in C.read_json_any_encoding(spark, d + "/*.json").select(
        F.get_json_object("json", "$.status").alias("s")).collect()]
    assert got == ["done", "done", "done"]


def test_tool_readers(spark):
    sem = json.dumps({"results": [{"check_id": "r1", "path": "a.js", "start": {"line": 1}, "end": {"line": 2},
                                   "extra": {"severity": "ERROR", "message": "m"}},
                                  {"check_id": "r2", "extra": {"severity": "WARNING"}},
                                  {"extra": {"message": "only message"}}]})
    docs = spark.createDataFrame([("s", sem), ("s", "{not json")], "scan_id string, json string")
    got = [(r.title, r.severity, r.file) for r in TL.read_semgrep(docs).orderBy("ord").collect()]
    assert got == [("r1", "High", "a.js"), ("r2", "Medium", ""), ("only message", "Low", "")]
    lines = spark.createDataFrame([
        ("s", 0, json.dumps({"DetectorName": "AWS", "SourceMetadata": {"Data": {"filepath": "k.txt"}}, "Verified": True})),
        ("s", 1, "progress: scanning"), ("s", 2, json.dumps({"rule": "Slack", "File": "x.env"}))],
        "scan_id string, ord int, value string")
    assert [(r.title, r.file, r.verified) for r in TL.read_trufflehog(lines).orderBy("ord").collect()] == \
        [("AWS", "k.txt", True), ("Slack", "x.env", False)]
    outd = spark.createDataFrame([("s", 0, json.dumps({"react": {"current": "17", "latest": "18"}})),
                                  ("s", 1, json.dumps({"react": {"current": "16", "latest": "18"}}))],
                                 "scan_id string, dir_ord int, json string")
    assert [(r.name, r.current) for r in TL.read_outdated(outd).collect()] == [("react", "16")]


def test_validate_requests(spark):
    rows = [("url", "https://github.com/a/b", None, None, None, None),
            (None, None, None, None, None, None),
            ("github", "not a url", None, None, "bad branch!", None),
            ("local", None, "  ", None, None, ["ok", " "]),
            ("zip", None, None, "@@@", "main", None),
            ("zip", None, None, base64.b64encode(b"x").decode(), "feature/x-1.2", ["a"])]
    df = spark.createDataFrame(rows, "inputType string, repoUrl string, localPath string, zipBuffer string, "
                                     "branch string, excludePaths array<string>")
    got = [[e.msg for e in r.errors] for r in VA.validate_requests(df).collect()]
    assert got[0] == [] and got[5] == []
    assert got[1] == ["inputType is required", "inputType must be one of github|url|local|zip"]
    assert got[2] == ["repoUrl must be a valid URL with protocol", "branch contains invalid characters"]
    assert got[3] == ["localPath is required for local scans", "excludePaths items must be non-empty strings"]
    assert got[4] == ["zipBuffer must be base64"]


def test_meaningful_and_normalize(spark):
    df = spark.createDataFrame([(" N/A ", 0, [0, 0], {"k": "unknown"}), ("x", 1, [0, 2], {"k": "v"})],
                               "s string, n int, a array<int>, m map<string,string>")
    got = [tuple(r) for r in df.select(*[VA.is_meaningful(df, c).alias(c) for c in df.columns]).collect()]
    assert got == [(False, False, False, False), (True, True, True, True)]
    docs = spark.createDataFrame([('["b", "a", "b"]',), ('[{"name": "z"}, {"x": 1}]',), ('{"f1": ["q", "p"], "f2": ["p"]}',)],
                                 "j string")
    assert [r.features for r in VA.normalize_features(docs, "j").collect()] == [["a", "b"], ["z"], ["p", "q"]]
    v = spark.createDataFrame([('{"module_name": "lodash", "via": ["Prototype pollution"], "level": "high", '
                                '"fixAvailable": {"name": "lodash", "version": "4.17.21"}}',), ('{}',)], "j string")
    got = [(r.vuln_name, r.vuln_title, r.vuln_severity, r.vuln_fix) for r in VA.normalize_vulns(v, "j").collect()]
    assert got == [("lodash", "Prototype pollution", "high", "lodash@4.17.21"),
                   ("Unknown Package", "Security vulnerability", "unknown", "N/A")]


def _tree_of(files):
    root = tempfile.mkdtemp(prefix="tree-", dir="/tmp")
    for path, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "wb") as f:
            f.write(data)
    return root


def test_corpus_hidden_files_bad_bytes_and_binaries(spark):
    root = _tree_of({"a.js": "caf\u00e9".encode("latin-1"), "b.bin": b"a \n\x00", ".github/workflows/ci.yml": b"on: push",
                  "deploy/x/.env": b"K=1", "only/.hidden/deep/_f.yml": b"\xff", "v.yml": b"k: 1", ".git/objects/x": b"z", "e.txt": b""})
    got = {r.path: r.content for r in C.read_corpus(spark, root, "s").collect()}
    assert got == {"a.js": "caf\ufffd", "b.bin": None, ".github/workflows/ci.yml": "on: push", "deploy/x/.env": "K=1",
                   "only/.hidden/deep/_f.yml": "\ufffd", "v.yml": "k: 1", ".git/objects/x": "z", "e.txt": ""}
    assert {r.path for r in C.read_corpus(spark, root, "s", glob="*.yml").collect()} == {
        ".github/workflows/ci.yml", "only/.hidden/deep/_f.yml", "v.yml"}
    assert ".git/objects/x" not in {r.path for r in C.read_corpus(spark, root, "s", prune=[".git"]).collect()}


def test_archives_keep_large_entries_and_report_bad_ones(spark):
    root = tempfile.mkdtemp(prefix="zips-", dir="/tmp")
    with zipfile.ZipFile(os.path.join(root, "good.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.js", "x" * 17_000_000)
        z.writestr("bad.txt", b"\xe9")
    with open(os.path.join(root, "broken.zip"), "wb") as f:
        f.write(b"no archive")
    got = {r.path: (r.size, r.content) for r in C.read_archives(spark, root + "/*.zip").collect()}
    assert got["big.js"] == (17_000_000, "x" * 17_000_000) and got["bad.txt"] == (1, "\ufffd")
    assert [(r.scan_id, r.path) for r in C.bad_archives(spark, root + "/*.zip").collect()] == [("broken", None)]


def test_one_archive_is_read_by_many_tasks(spark):
    """Spans of entries go to tasks of their own; methods, odd entries and broken ones are as zipfile sees them."""
    root = tempfile.mkdtemp(prefix="zips-", dir="/tmp")
    path = os.path.join(root, "one.zip")
    methods = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    texts = {f"src/f{i}.js": f"// {i}\n" * (i * 40) for i in range(40)}  # the first one is empty
    with open(path, "wb") as f:
        f.write(b"#!/bin/sh\n")  # bytes before the archive
    with zipfile.ZipFile(path, "a") as z:
        z.mkdir("src")
        for i, (name, text) in enumerate(texts.items()):
            z.writestr(name, text, compress_type=methods[i % 4])
        z.writestr("logo.bin", b"\x00\x01")
        z.writestr("hurt.js", "y" * 500)
        hurt = z.getinfo("hurt.js")
    with open(path, "r+b") as f:
        f.seek(hurt.header_offset + 30 + len("hurt.js") + 7)
        f.write(b"z")
    spans = A.entry_spans(spark, root + "/*.zip", span_bytes=2000)
    assert spans.select("span").distinct().count() > 5
    rows = A.archive_rows(spark, root + "/*.zip", span_bytes=2000)
    got = rows.withColumn("task", F.spark_partition_id()).collect()
    assert {r.path: r.content for r in got} == {**texts, "logo.bin": None, "hurt.js": None}
    assert [r.path for r in got if r.error] == ["hurt.js"]
    assert len({r.task for r in got}) > 1


def test_archive_beyond_two_gigabytes(spark):
    """A sparse file: entries behind 3 GB of nothing, offsets as in a 64-bit archive."""
    root = tempfile.mkdtemp(prefix="zips-", dir="/tmp")
    path = os.path.join(root, "huge.zip")
    with open(path, "wb") as f, zipfile.ZipFile(f, "w") as z:
        z.writestr("first.js", "fetch()")
        f.seek(5 << 30)
        z.start_dir = f.tell()
        z.writestr("last.js", "last()")
    assert os.path.getsize(path) > 5 << 30 and os.stat(path).st_blocks * 512 < 1 << 20
    got = {r.path: r.content for r in C.read_archives(spark, root + "/*.zip").collect()}
    assert got == {"first.js": "fetch()", "last.js": "last()"}
    assert C.bad_archives(spark, root + "/*.zip").count() == 0


def test_any_encoding_survives_bad_bytes(spark):
    root = _tree_of({"a.json": b'{"a": "\xe9"}', "b.json": b"\xff\xfe" + "{}".encode("utf-16-le") + b"x"})
    got = {r.path.rsplit("/", 1)[1]: r.json for r in C.read_json_any_encoding(spark, root + "/*.json").collect()}
    assert got == {"a.json": '{"a": "\ufffd"}', "b.json": "{}"}


def test_tool_records_are_parsed_once_and_bad_ones_are_told(spark):
    lines = [("s", 0, '{"DetectorName": "AWS", "SourceMetadata": {"Data": {"filepath": ""}}, "path": "p.js", "Verified": false, "verified": true}'),
             ("s", 1, "scanning repository"), ("s", 2, '{"rule": 5, "File": "f"'), ("s", 3, " "), ("s", 4, None), ("s", 5, "[1]"),
             ("s", 6, '{"rule": 5, "File": "f", "Verified": "no such"}')]
    df = spark.createDataFrame(lines, "scan_id string, ord int, value string")
    out = TL.read_trufflehog(df)
    assert [(r.ord, r.title, r.file, r.verified) for r in out.orderBy("ord").collect()] == [(0, "AWS", "p.js", True), (6, "5", "f", False)]
    assert sorted(r.ord for r in TL.bad_records(df, "value").collect()) == [1, 2]

    docs = spark.createDataFrame([("a", 1, '{"results": [{"check_id": "x", "start": {"line": 3}, "extra": {"severity": "ERROR"}}, null, 7]}'),
                                  ("b", 1, '{"results": {}}'), ("c", 1, "{"), ("d", 1, None), ("e", 1, '{"vulnerabilities": {"m": {"severity": "low", '
                                   '"fixAvailable": {"name": "n"}}, "k": null}, "x": {"current": "1"}}'), ("e", 2, '{"x": {"latest": "2"}}')],
                                 "scan_id string, dir_ord int, json string")
    got = [(r.scan_id, r.ord, r.title, r.severity, r.range.start) for r in TL.read_semgrep(docs).orderBy("ord").collect()]
    assert got == [("a", 0, "x", "High", 3), ("a", 1, "Semgrep finding", "Low", None), ("a", 2, "Semgrep finding", "Low", None)]
    assert sorted((r.name, r.severity, r.fix) for r in TL.read_audit(docs).collect()) == [("k", None, None), ("m", "low", '{"name":"n"}')]
    assert [(r.current, r.latest) for r in TL.read_outdated(docs).filter("name = 'x'").collect()] == [(None, "2")]
    assert [r.scan_id for r in TL.bad_records(docs).collect()] == ["c"]
    for read, source in ((TL.read_trufflehog, df), (TL.read_semgrep, docs), (TL.read_audit, docs), (TL.read_outdated, docs)):
        plan = read(source)._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "get_json_object" not in plan


def test_diffs_in_parts(spark):
    """Parts in order are the whole diff, however small they are; offsets are bytes, files are read back in order of their names."""
    rows = [("a/b", i, f"f{i}.js" if i % 3 else None, f"old {i}" if i % 2 else None, f"n\u00e9w {i}\nx", "+ patch" if i % 7 == 0 else None) for i in range(60)]
    rows += [("c", 1, "only.js", "x", "y", None)]
    df = spark.createDataFrame(rows, "scan_id string, ord int, file string, original string, modified string, patch string")
    want = {r.scan_id: r["diff"] for r in X.build_diff(df).collect()}
    for part_bytes in (1, 100, 1 << 20):
        parts = X.diff_parts(df, part_bytes=part_bytes)
        got = {}
        for r in sorted(parts.collect(), key=lambda r: (r.scan_id, r["at"])):
            before = got.setdefault(r.scan_id, [])
            assert r["at"] == sum(len(t.encode()) + 1 for t in before)
            before.append(r.text)
        assert {k: "\n".join(v) for k, v in got.items()} == want
    assert len(got["a/b"]) == 1
    root = tempfile.mkdtemp(prefix="diffs-", dir="/tmp")
    K.write_diffs(X.diff_parts(df, part_bytes=100), root)
    names = sorted(os.listdir(os.path.join(root, "a%2Fb")))
    assert len(names) > 5 and "\n".join(open(os.path.join(root, "a%2Fb", n), encoding="utf-8", newline="").read() for n in names) == want["a/b"]
