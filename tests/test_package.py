"""The package as an executor sees it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("welch_t", "inverse_binomial_pmf", "beta_lift", "amount_comparison", "zero_inflated_fit"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
from tidemark.operators import similarity
prefs = spark.createDataFrame([(u, i) for u in range(4) for i in range(9)], "user_id LONG, item_id LONG")
assert similarity.shared_users(prefs, chunk=1).count() == 36
print("done")
"""


def test_workers_need_no_installed_copy(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]
