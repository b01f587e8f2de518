"""The driver's entry with and without the training-corpus part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
from brindle.plans import catalog
assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.SQL), sorted(e.queries())
"""


@pytest.mark.parametrize("gone", [["brindle/llm", "tests/llm"], ["brindle/llm", "tests/llm", "corpus_pipeline.py"], ["brindle/llm/queries.py", "tests/llm"]])
def test_entry_without_the_corpus_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert not done.returncode, done.stderr


def test_names_and_sql_agree():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
