"""The library without the training-data subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_entry_works_without_them(tmp_path, kept):
    """Without the subpackage, with and without the pipeline's own file; a copy elsewhere on the path changes nothing."""
    if any(not (REPO / p).exists() for p in kept):
        pytest.skip("the file is gone already")
    for p in ("linkloom", "__spark_entry__.py", *kept):
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "linkloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'link_status_summary' in q and set(o) <= set(q) and not any(n.startswith('op') for n in q) and 'pipeline' not in q, list(q)"
    for path in ("", str(REPO)):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_it():
    for p in (REPO / "linkloom").rglob("*.py"):
        if "llm" not in p.relative_to(REPO / "linkloom").parts:
            assert "linkloom.llm" not in p.read_text(), p
