"""The registered queries that SQL can express, against their SQL."""

import duckdb
import pytest

from stemma.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, D).toArrow()
    want = duck.execute(Q.oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in zip(*(t.column(n).to_pylist() for n in names)))
    assert rows(got) == rows(want)
