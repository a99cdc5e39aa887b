"""The entry module works where the repository is not: an empty working directory and workers without the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_elsewhere", {os.path.join(ROOT, "__spark_entry__.py")!r})
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", *[e.queries()[q](spark, "/root/testdata/sf0.001").count() for q in ("mdl_ar", "fc_forecast")])
"""


def test_python_stages_run_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 5 120" in out.stdout, out.stderr[-3000:]
