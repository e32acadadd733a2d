"""The entry module with and without the operators on training text."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_text_operators(tmp_path, left_out):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".*", "__pycache__", "*.json", *left_out))
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, ops, pipeline, whole = done.stdout.split()
    assert int(n) > 100 and (ops, pipeline, whole) == ("0", "False", "True")
