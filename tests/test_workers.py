"""Python workers find the package when the application runs from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("dense_search", "hybrid_search"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(line.split()[1]) > 0 for line in done.stdout.split("\n") if line.startswith(("dense", "hybrid")))
