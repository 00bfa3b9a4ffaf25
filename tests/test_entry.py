"""The driver's contract."""
import importlib.util
import subprocess
import sys

import __spark_entry__ as e


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.count() > 0 and "binding_index" in df.columns


def test_sql_names_are_query_names():
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_imports_without_the_llm_subpackage():
    code = """
import importlib.util as u
find = u.find_spec
u.find_spec = lambda name, *a: None if name.startswith(("lodestone.llm", "corpus_pipeline")) else find(name, *a)
import sys
import __spark_entry__ as e
assert not any(q.startswith("op") or q == "pipeline" for q in e.queries()) and len(e.queries()) > 80
assert not any(m.startswith("lodestone.llm") for m in sys.modules)
"""
    root = importlib.util.find_spec("__spark_entry__").origin.rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, check=False).returncode == 0
