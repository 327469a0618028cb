"""The driver's entry is read in a fresh process before any session is open."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_are_read_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext as c; q, o = e.queries(), e.oracle_sql(); assert c._active_spark_context is None and q and set(o) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
