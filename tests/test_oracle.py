"""Every registered point query against its oracle SQL on the small tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def _names():
    from pointloom.plans.registry import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", _names())
def test_query_equals_oracle(spark, oracle, name):
    from pointloom.plans.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    cur = oracle.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(tuple(map(tidy, r)) for r in cur.fetchall())
    assert sorted(tuple(tidy(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
