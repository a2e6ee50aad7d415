"""The pipeline's stages against brute force, and the entry point's guard."""

import os
import subprocess
import sys
from collections import Counter

import brute
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from codelens.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_in_order():
    assert [n for n, _f in P.STAGES] == ["quality_rules", "ngram_join", "decontamination", "mixing", "sharding"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _name, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_each_stage(spark, steps):
    docs, good, single, clean, mixed, sharded = steps
    for df in (good, single, clean, mixed):
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs, quality_rules.fit(docs, labels)).collect()}
    assert sorted(d for d, _t in rows(good)) == sorted(d for d, k in verdict.items() if k)
    assert sorted(d for d, _t in rows(single)) == sorted(d for d, _n, c in brute.near_groups(rows(good)) if d == c)
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _i in brute.leaks(rows(single), bench)}
    assert sorted(d for d, _t in rows(clean)) == sorted(d for d, _t in rows(single) if d not in dirty)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert Counter(d for d, _t in rows(mixed)) == +Counter(copies)
    assert Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in sharded.collect()) == Counter(
        (d, brute.jump(d, 16), brute.jump(d, 17)) for d, _t in rows(mixed))


def test_run(spark, steps):
    out = P.run(spark, SF)
    assert Counter((r["doc_id"], r["shard"]) for r in out.collect()) == Counter((r["doc_id"], r["shard"]) for r in steps[-1].collect())


def test_odd_documents_pass_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _name, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_entry_point_works_without_the_folders(tmp_path):
    """With the corpus folders gone, the entry point imports and has the other queries."""
    os.makedirs(tmp_path / "codelens")
    for name in os.listdir(ROOT):
        if name not in ("codelens", "corpus_pipeline.py", ".git", "tests"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    for name in os.listdir(os.path.join(ROOT, "codelens")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "codelens", name), tmp_path / "codelens" / name)
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f:
        source = f.read()
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(source)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), e.llm)"],
                          cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, pipeline, llm = done.stdout.split()
    assert int(n) > 100 and pipeline == "False" and llm == "None"
