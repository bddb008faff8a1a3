"""The entry file without the operators for training text."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.txt"))
    done = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"],
        cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120,
    )
    assert done.returncode == 0, done.stderr
    own, checks, pipeline = done.stdout.split()
    assert own == checks and int(own) > 60 and pipeline == "False"
