"""Every registered store query against its SQL, on the smallest tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def entry():
    import __spark_entry__

    return __spark_entry__


def _store_queries():
    from recollect.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted(tuple(f"{x + 0.0:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
@pytest.mark.parametrize("name", _store_queries())
def test_query_matches_sql(spark, duck, name):
    from recollect.plans import catalog

    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == columns
        assert plain(got) == plain(rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_points(spark):
    e = entry()
    assert e.entry(spark).columns == ["id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
