"""A session that was started elsewhere finds the package in its workers."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from pairlens.session import scratch_path, shared_dir

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pairlens.session import local_session
spark = local_session(cores=2, shuffle_partitions=2)
print("rows", e.queries()["i5_em_impute"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_with_python_workers_run_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows 5" in out.stdout, out.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch, spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Bare)
    assert isinstance(spark, SparkSession)
