"""The driver's entry points without the training-data operators, as they are after their folders are deleted."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); assert len(q) > 60; assert 'pipeline' not in q; assert not any(x.startswith('op') and x[2].isdigit() for x in q)"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_points_without_the_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", "metastore_db"))
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
