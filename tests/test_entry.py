"""The driver's functions, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


def counts(folder):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, timeout=120, check=True)
    return [int(x) for x in out.stdout.split()]


def test_queries_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    few, sql, corpus = counts(copy)  # the pipeline's file is still there
    assert few > 70 and sql > 60 and corpus == 0
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert counts(copy) == [few, sql, 0]
    (copy / "depweave" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted folder may leave
    assert counts(copy) == [few, sql, 0]


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["target", "source"] and df.count() > 0
