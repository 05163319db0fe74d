"""The driver's entry where the optional parts are not installed, on a copy of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import os, __spark_entry__ as e
assert os.path.dirname(os.path.abspath(e.__file__)) == os.getcwd()
names = set(e.queries())
assert "bm25_topk" in names and set(e.oracle_sql()) <= names
print(sorted(n for n in names if n == "pipeline" or n[:2] == "op" and n[2].isdigit()))
"""


@pytest.mark.parametrize("gone", [["cairn/llm", "tests/llm"], ["cairn/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_imports_without_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0 and done.stdout.strip() == "[]", done.stderr
