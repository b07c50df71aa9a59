"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


def run(where):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=where, env=os.environ | {"PYTHONPATH": where}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy(tmp_path, *left_out):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in left_out:
        path = tmp_path / "repo" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return str(tmp_path / "repo")


def test_without_the_folders(tmp_path):
    n, pipeline, ops = run(copy(tmp_path, "scanlake/llm", "tests/llm"))
    assert int(n) > 100 and (pipeline, ops) == ("False", "False")


def test_without_folders_and_pipeline(tmp_path):
    n, pipeline, ops = run(copy(tmp_path, "scanlake/llm", "tests/llm", "corpus_pipeline.py"))
    assert int(n) > 100 and (pipeline, ops) == ("False", "False")


def test_without_the_pipeline_alone(tmp_path):
    _, pipeline, _ = run(copy(tmp_path, "corpus_pipeline.py"))
    assert pipeline == "False"
