"""The registry loads without a session, a JVM or the jars beside pyspark."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CHILD = """
import builtins, glob, os, zipfile
import pyspark
home = os.path.dirname(pyspark.__file__)
real_open = builtins.open
def guarded(path, *a, **k):
    if "jars" in str(path) and str(path).startswith(home):
        raise FileNotFoundError(path)
    return real_open(path, *a, **k)
builtins.open = guarded
glob.glob = lambda *a, **k: []
import __spark_entry__ as E
q, o = E.queries(), E.oracle_sql()
from pyspark.sql import SparkSession
assert SparkSession.getActiveSession() is None
assert set(o) <= set(q) and all(isinstance(v, str) for v in o.values())
print(len(q))
"""


def test_queries_load_without_jars_or_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "SPARK_HOME"} | {"PYTHONPATH": ROOT, "JAVA_HOME": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", CHILD], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) >= 102
