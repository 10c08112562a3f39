"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_subpackage(tmp_path):
    """With its folders gone, and with corpus_pipeline.py left or gone, the other queries are there and nothing fails."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); print(len(q), sorted(set(s) - set(q)))"
    for gone in ((), ("corpus_pipeline.py",)):
        for x in gone:
            (copy / x).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr
        n, more = done.stdout.split(" ", 1)
        assert int(n) > 90 and more.strip() == "[]"


def test_names():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
