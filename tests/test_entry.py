"""The registered queries without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("keep_pipeline", [False, True])
def test_core_stands_without_the_optional_operators(tmp_path, keep_pipeline):
    from framewise.plans import catalogue

    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *(() if keep_pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    told = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert told == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False"]
