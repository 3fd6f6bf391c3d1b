"""Functions that run on the executors, with the package neither installed nor in the working folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
queries = entry.queries()
print("ROWS", queries["knn_nearest"](spark, {SF!r}).count())
from breathline.sources import files
open("x.csv", "w").write("a,b\\n")
print("NAMES", files.header_columns(spark, "x.csv").count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_workers_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "ROWS" in done.stdout and "NAMES 2" in done.stdout
