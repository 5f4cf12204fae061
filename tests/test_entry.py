"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s), 'pipeline' in q)"


@pytest.mark.parametrize("path", ["", str(REPO)])
@pytest.mark.parametrize("gone", [(), ("corvane/llm", "tests/llm"), ("corvane/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_parts(tmp_path, gone, path):
    """Whatever of the optional parts is deleted, the other queries and their SQL are there, whatever else the path holds."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for name in gone:
        part = copy / name
        shutil.rmtree(part) if part.is_dir() else part.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True).stdout.split()
    from corvane.plans import registry

    llm = (copy / "corvane/llm/queries.py").exists()
    pipeline = llm and (copy / "corpus_pipeline.py").exists()
    assert int(said[0]) == len(registry.queries()) + 13 * llm + pipeline and (said[2] == "True") == pipeline
