"""The entry's queries run although workers cannot find the package by themselves."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import importlib.util, os
spec = importlib.util.spec_from_file_location("entry_module", os.environ["ENTRY"])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
    .getOrCreate())
for name in ("code_nodes", "rate_limit"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["ENTRY"] = os.path.join(ROOT, "__spark_entry__.py")
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert set(counts) == {"code_nodes", "rate_limit"}, done.stderr[-2000:]
    assert all(int(n) > 0 for n in counts.values())
