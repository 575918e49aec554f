import glob
import os

import pytest

from plainlens.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: "null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert cells([tuple(r) for r in df.collect()], df.columns) == cells(rel.fetchall(), rel.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
