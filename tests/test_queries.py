"""Every registered query against its DuckDB counterpart, and the shape of the plans."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "BatchEvalPython"]:
        assert slow not in plan
    ours = df.toPandas()
    if name in ORACLE:
        assert difference(ours, con.sql(ORACLE[name]).df()) is None
    else:
        assert len(ours)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_corpus_operators(tmp_path, left_out):
    """A copy without those folders still imports and offers all other queries."""
    copy = copytree(Path(entry.__file__).parent, tmp_path / "copy", ignore=ignore_patterns(*left_out, ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    own = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]
    assert out == [str(len(own)), "False", str(len([n for n in ORACLE if n in own]))]
