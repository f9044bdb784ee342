import os
import shutil

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_exact import brute as copies
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_groups
from weftline.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        got = stage(spark, docs, SF)
        rows = [tuple(r) for r in got.collect()]
        if name != "packing":
            assert got.columns == docs.columns and set(rows) <= set(before)
        kept = {r[0] for r in rows}
        if name == "quality classifier":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert kept == {r[0] for r in before if model.tails([r[1]])[0, 1] >= 0.75}
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
            assert len(good & kept) > 0.97 * len(good)
        elif name == "exact dedup":
            assert kept == {r[0] for r in before} - {i for i, _ in copies(before)[0]}
        elif name == "simhash near-dedup":
            a, b, has = simhash.signatures([r[1] for r in before])
            assert kept == {i for i, root in brute_groups([r[0] for r in before], a, b, has).items() if i == root}
        elif name == "benchmark decontamination":
            tests = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in before} - {i for i, _, _ in leaks([r[:2] for r in before], tests)}
        else:
            check(got.collect(), [(r[0], len(r[1].split())) for r in before], 2048)
        docs = got


def test_run_and_tables_without_rows(spark, tmp_path):
    assert pipeline.run(spark, SF).count() > 0
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    empty = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_the_stages(spark, odd, tmp_path):
    """Without ratings, then with those of the smallest tables."""
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for sf in (str(tmp_path), SF):
        docs = odd
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert docs.count() > 0 or sf == SF
            assert name == "packing" or docs.columns == odd.columns


@pytest.mark.parametrize("grade", [(0, 0), (1, 1), (1, 0)])
def test_ratings_of_one_grade(spark, tmp_path, grade):
    for t in ("documents", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.selectExpr("doc_id", f"{grade[0]} as quality", f"{grade[1]} as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    kept = pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count()
    assert kept == (docs.where("trim(text) != ''").count() if grade == (1, 0) else 0)


def test_entry_without_the_subpackage(tmp_path):
    """Without the folders and the pipeline the entry still imports."""
    import subprocess
    import sys

    root = os.path.dirname(entry.__file__)
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert "op1_" not in out.stdout and "pipeline" not in out.stdout


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_one_query_for_each_operator(name):
    assert sum(q.startswith(name) for q in entry.queries()) == 1
