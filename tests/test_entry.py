"""The entry module, with and without the llm part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "heronlake"), tmp_path / "heronlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    # the other tests are found without it too, and run: here the quick ones and the entry's
    some = ["-q", "-x", "-p", "no:cacheprovider", "-k", "test_urls or test_tokenizer or test_entry_runs or (test_equals_sql and robots_url)"]
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env=env, check=True, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "tests", *some], cwd=tmp_path, env=env, check=True, stdout=subprocess.DEVNULL)
