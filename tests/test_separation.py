"""The rest of the library works without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as contract
from sparkassay import workload
names = contract.queries().keys()
assert names == workload.QUERIES.keys() and contract.oracle_sql().keys() == workload.ORACLE.keys(), names
assert not [m for m in __import__("sys").modules if m.startswith("sparkassay.llm")]
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_import_without_training_data(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "sparkassay").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sparkassay.llm" not in path.read_text(), path
