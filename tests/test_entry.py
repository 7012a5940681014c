"""The entry module in processes of its own: without a session, and with workers that don't have the package."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="spark-", dir="/tmp"), env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_queries_need_no_session():
    out = run(f"import sys; sys.path.insert(0, {ROOT!r})\nimport __spark_entry__ as e\nprint(len(e.queries()) > 150, set(e.oracle_sql()) <= set(e.queries()))")
    assert out.split() == ["True", "True"]


def test_workers_get_the_package():
    """``sys.path`` of the driver alone names the package; a query that runs Python on the workers still works."""
    out = run(f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["wkt_round_trip"](s, "/root/testdata/sf0.001").count())
""")
    assert "rows" in out
