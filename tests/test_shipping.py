"""Queries with Python workers run wherever the driver was started from."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
query = entry.queries()["q_topk_similarity"]
print("ROWS", query(spark, "/root/testdata/sf0.001").count() >= 0, query(spark, "/root/testdata/sf0.001").count() >= 0)
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS True True" in said.stdout, said.stderr[-2000:]
