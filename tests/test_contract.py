"""The contract imports anywhere: no session, no Spark jars, no optional parts."""

import os
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

from themeloom.functions.text import stop_words

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_contract_without_jars_or_session():
    code = """
import glob, os
real = os.listdir
glob.glob = lambda *a, **k: []
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 94 and set(o) <= set(q), set(o) - set(q)
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""
    done = run(code)
    assert done.returncode == 0, done.stderr


def test_contract_without_the_optional_parts():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "themeloom.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) >= 94 and not [k for k in e.queries() if k.startswith("op1_") or k == "pipeline"]
assert e.oracle_sql()
"""
    done = run(code)
    assert done.returncode == 0, done.stderr


def test_stop_words_are_sparks_own(spark):
    assert list(stop_words()) == StopWordsRemover.loadDefaultStopWords("english")
