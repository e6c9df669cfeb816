"""The page engine works without the training-data operators."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_without_training_data_operators(tmp_path):
    for name in ("quire", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_count' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_entry_needs_no_session():
    """Queries are listed before any session is there."""
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
