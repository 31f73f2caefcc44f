"""The entry's queries where the optional subpackage, or a package it needs, is missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    return tmp_path


def counts(folder):
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(n) for n in done.stdout.split()]


def test_without_the_subpackage(copy):
    queries, sql, optional = counts(copy)
    assert queries > 70 and sql > 60 and optional == 0


def test_with_the_pipeline_left_behind_or_an_empty_folder(copy):
    (copy / "corpus_pipeline.py").write_text("from tidemark.llm.common import table\n")
    (copy / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)
    assert counts(copy)[2] == 0


def test_without_a_package_that_the_subpackage_needs(copy):
    (copy / "tidemark" / "llm").mkdir()
    (copy / "tidemark" / "llm" / "__init__.py").write_text("")
    (copy / "tidemark" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    assert counts(copy)[2] == 0


def test_an_error_inside_the_subpackage_comes_out(copy):
    (copy / "tidemark" / "llm").mkdir()
    (copy / "tidemark" / "llm" / "__init__.py").write_text("")
    for line in ("from .misspelt import x", "from tidemark.plans import misspelt"):
        (copy / "tidemark" / "llm" / "queries.py").write_text(line + "\n")
        done = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode and "misspelt" in done.stderr
