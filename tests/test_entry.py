import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_flagship_query_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("leftover", [False, True])
def test_library_works_without_the_training_operators(tmp_path, leftover):
    """The two folders of those operators are gone; corpus_pipeline.py and an emptied folder may be left."""
    root = Path(entry.__file__).parent
    for p in ("nadir", "__spark_entry__.py", *(["corpus_pipeline.py"] if leftover and (root / "corpus_pipeline.py").exists() else [])):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "nadir/llm", ignore_errors=True)
    if leftover:
        (tmp_path / "nadir/llm/__pycache__").mkdir(parents=True)
    check = "import __spark_entry__ as e; q = {**e.queries(), **e.oracle_sql()}; assert 'pair_rollup_basic' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    got = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
