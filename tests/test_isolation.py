"""The rest of the library without the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e, sweepflow.jobs.queries as jobs
assert set(e.queries()) == set(jobs.queries()) and set(e.oracle_sql()) == set(jobs.oracle_sql())
"""


def copied(path, leave_out):
    """The repository without some folders, as after they are deleted."""
    shutil.copytree(ROOT, path, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), ROOT) in leave_out])
    return subprocess.run([sys.executable, "-c", CODE], cwd=path, env={**os.environ, "PYTHONPATH": str(path)}, capture_output=True, text=True)


def test_queries_without_the_text_folders(tmp_path):
    done = copied(tmp_path / "a", ["sweepflow/llm", "tests/llm"])
    assert done.returncode == 0, done.stderr


def test_queries_without_the_pipeline_too(tmp_path):
    done = copied(tmp_path / "b", ["sweepflow/llm", "tests/llm", "corpus_pipeline.py"])
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_text_folder():
    for folder, _, names in os.walk(os.path.join(ROOT, "sweepflow")):
        if os.path.relpath(folder, ROOT).startswith(os.path.join("sweepflow", "llm")):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
