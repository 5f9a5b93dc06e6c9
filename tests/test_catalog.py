"""Every registered query against its SQL on the same tables."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from panelcore import catalog

TABLES = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")

# Learned models and sampled attributions have no SQL; unit tests check them.
ROWS_ONLY = {"ridge_metrics", "gradient_boosting_metrics", "project_recursive_ridge",
             "sampled_attribution", "ridge_attribution"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    got = _rows(df.columns, df.collect())
    if name in ROWS_ONLY:
        assert got and name not in ORACLES
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, cursor.fetchall())


def test_importing_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
