"""Every query against DuckDB on the same tables, as the driver compares them."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from nephos.plans import catalogue

@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, str):
        return x
    return round(float(x), 6) + 0.0


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    answer = tables.execute(catalogue.ORACLE_SQL[name])
    assert got == rows([c[0] for c in answer.description], answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data subpackage the entry module imports and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "nephos", tmp_path / "nephos", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE_SQL))]
