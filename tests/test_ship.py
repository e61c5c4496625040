"""Queries with Python workers, in a session that was started elsewhere and knows of the package only by the driver's path."""

import os
import subprocess
import sys

import pytest

DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["rx_routes", "rx_table_refs", "manifest_read", "parse_symbols", "imports_resolve", "lease_fold", "task_state", "req_open", "session_open", "st_lease_ttl", "src_repo_walk"]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in sys.argv[3:]:
    print("rows", name, entry.queries()[name](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no input tables here")
def test_queries_without_pythonpath(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME") and not k.startswith("PYSPARK")} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, DIR, *NAMES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    found = dict(line.split()[1:] for line in done.stdout.splitlines() if line.startswith("rows "))
    assert sorted(found) == sorted(NAMES), done.stderr[-2000:]
    assert all(int(n) > 0 for n in found.values())
