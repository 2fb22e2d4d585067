import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm").mkdir()  # a folder left behind is not the subpackage
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=60)


def test_the_rest_works_where_the_corpus_operators_cannot_be_imported(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}, check=True, timeout=60)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(f"{ROOT}/tidemark"):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "tidemark.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
