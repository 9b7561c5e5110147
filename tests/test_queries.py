"""The registered queries against DuckDB on the smallest test tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans.queries import QUERIES, SQL, TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    told = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert told(got) == told(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_text_operators(tmp_path):
    """The entry module imports, with the relational queries alone, where the optional parts are missing."""
    import shutil
    import subprocess

    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{top}/quarry", f"{tmp_path}/quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'scan_star' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
