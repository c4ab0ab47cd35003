"""The registry on the smallest given tables against its SQL twins."""

import ast
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from tramline.plans.oracle import oracle_sql
from tramline.plans.queries import QUERIES
from check_oracle import TABLES, table_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, tables, name):
    frame = QUERIES[name](spark, FOLDER)
    result = tables.execute(oracle_sql()[name])
    columns = [column[0] for column in result.description]
    found = [tuple(row) for row in frame.collect()]
    assert sorted(frame.columns) == sorted(columns)
    assert table_rows(frame.columns, found) == table_rows(columns, result.fetchall())


def test_imports_without_the_corpus_subpackage(tmp_path):
    """A copy without the corpus folders, with and without the pipeline, still lists the other queries."""
    root = pathlib.Path(entry_points.__file__).resolve().parent
    for pipeline in (True, False):
        copy = tmp_path / f"copy{pipeline}"
        shutil.copytree(root / "tramline", copy / "tramline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
            if (root / name).exists():
                shutil.copy(root / name, copy / name)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False)
        assert run.returncode == 0, run.stderr
        assert run.stdout.split() == [str(len(QUERIES)), str(len(oracle_sql()))]


def test_no_module_rebinds_a_function():
    """A name defined at the top of a module is not given to anything else there."""
    root = pathlib.Path(entry_points.__file__).resolve().parent
    for path in sorted((root / "tramline").rglob("*.py")):
        tree = ast.parse(path.read_text())
        defined = [node.name for node in tree.body if isinstance(node, ast.FunctionDef | ast.ClassDef)]
        bound = [
            name.id for node in tree.body if not isinstance(node, ast.FunctionDef | ast.ClassDef)
            for name in ast.walk(node) if isinstance(name, ast.Name) and isinstance(name.ctx, ast.Store)
        ]
        assert len(set(defined)) == len(defined) and not set(defined) & set(bound), path
