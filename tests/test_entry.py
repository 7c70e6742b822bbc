"""The entry module in an installation with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
REPORT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'store_margin' in e.queries())"


def installation(folder: Path, *left_out: str) -> Path:
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *left_out))
    return folder


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_import_without_training_data_operators(tmp_path, left_out):
    folder = installation(tmp_path / "copy", *left_out)
    found = subprocess.run([sys.executable, "-c", REPORT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    queries, texts, flagship = found.stdout.split()
    assert int(queries) >= 122 and queries == texts and flagship == "True"
