import os
import subprocess
import sys

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_odd_and_empty_tables(spark, odd, odd_rows, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        more = ["copies"] if name == "mixing" else []
        assert out.columns == [*corpus_pipeline.COLUMNS, *more]
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r[0] for r in odd_rows}
        assert stage(spark, none, SF).count() == 0


def test_decisions_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.count()
        assert 0 < after <= before
        if name in ("quality", "near_dedup"):
            assert after < before
        if name == "decontamination":
            found = corpus_pipeline.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), columns=corpus_pipeline.COLUMNS)
            assert found.exceptAll(docs).count() == 0
        if name == "personal_data":
            assert docs.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.]com'").count() == 0 and docs.where("text like '%<EMAIL>%'").count() > 0
        assert docs.where("n_chars <> length(text)").count() == 0
        before = after


@pytest.mark.parametrize("hide", [True, False])
def test_the_entry_imports_without_the_subpackage(hide, tmp_path):
    code = "import sys\n" + "sys.modules['corpus_pipeline'] = None\n" * hide + "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(k.startswith('op') for k in e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True)
    n, pipeline, ops = out.stdout.split()
    assert (pipeline, ops) == (str(not hide), str(not hide)) and int(n) >= 89, out.stderr
