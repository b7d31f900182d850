"""The driver's contract."""

import ast
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from plumbline import plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DIR = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in plans.oracle_sql()])
def test_against_duckdb(spark, con, name):
    assert rows(plans.queries()[name](spark, DIR).toPandas()) == rows(con.execute(plans.oracle_sql()[name]).df())


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def told_without(tmp_path, *gone):
    """(number of queries, whether op queries are there, whether the pipeline is) in a copy that lacks some files or folders."""
    for n in ("__spark_entry__.py", "corpus_pipeline.py"):
        if n not in gone and os.path.exists(os.path.join(ROOT, n)):
            os.symlink(os.path.join(ROOT, n), tmp_path / n)
    os.makedirs(tmp_path / "plumbline")
    for n in os.listdir(os.path.join(ROOT, "plumbline")):
        if f"plumbline/{n}" not in gone:
            os.symlink(os.path.join(ROOT, "plumbline", n), tmp_path / "plumbline" / n)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("gone", [("plumbline/llm",), ("plumbline/llm", "corpus_pipeline.py")])
def test_without_the_optional_part(tmp_path, gone):
    """The entry imports, and only its own queries are left, where the optional folder is gone, with the pipeline's file or without."""
    assert told_without(tmp_path, *gone) == [str(len(plans.queries())), "False", "False"]


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "plumbline", "llm")), reason="the optional part is not there")
def test_without_the_pipeline_alone(tmp_path):
    n, ops, pipeline = told_without(tmp_path, "corpus_pipeline.py")
    assert int(n) > len(plans.queries()) and (ops, pipeline) == ("True", "False")


def test_nothing_else_imports_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "plumbline")):
        for n in names:
            if n.endswith(".py") and os.path.basename(folder) != "llm":
                tree = ast.parse(open(os.path.join(folder, n), encoding="utf-8").read())
                found = [x.module or "" for x in ast.walk(tree) if isinstance(x, ast.ImportFrom)] + [a.name for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names]
                assert not any(m.startswith("plumbline.llm") for m in found), n
