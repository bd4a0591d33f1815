import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_point

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["returnflag", "date", "files", "first_sha1"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'status_diff' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_works_without_a_package_that_the_corpus_operators_need():
    code = "import sys; sys.modules['ahocorasick'] = sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'status_diff' in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
