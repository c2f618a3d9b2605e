"""The driver contract, with and without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 5 and "total_tokens" in df.columns


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(os.path.join(root, "meterlark"), tmp_path / "meterlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'digest_by_source' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
