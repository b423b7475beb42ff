"""The rest of the library works where the llm folders and the pipeline are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as entry
from tidemark.plans import catalog
assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
"""


def copied(tmp_path, *gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)


def test_without_llm_and_pipeline(tmp_path):
    done = copied(tmp_path, "llm", "corpus_pipeline.py")
    assert done.returncode == 0, done.stderr


def test_without_llm_alone(tmp_path):
    done = copied(tmp_path, "llm")
    assert done.returncode == 0, done.stderr
