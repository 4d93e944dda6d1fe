"""Each registered query against its SQL on the smallest tables."""

import glob

import duckdb
import pytest

from seqloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2][:-8]} AS SELECT * FROM '{path}'")
    return con


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert sorted(map(tuple, rows.select(*columns).collect()), key=key) == want
