"""Every query of the catalogue runs, and agrees with its SQL where it has one."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from corpusloom.plans.catalogue import ORACLE_SQL, QUERIES  # noqa: E402


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(v[i], 5) if isinstance(v[i], float) else v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small)
    values = [tuple(r) for r in got.collect()]
    spark.catalog.clearCache()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(small):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{small}/{f}')")
        cur = con.execute(ORACLE_SQL[name])
        assert rows(got.columns, values) == rows([c[0] for c in cur.description], cur.fetchall())
    else:
        assert values
