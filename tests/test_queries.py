"""Every registered query of the catalogue side against its SQL on the smallest tables."""

import duckdb
import pytest

from stemma.plans import registry

D = "/root/testdata/sf0.001"
#: Queries without SQL, and the tests that hold their operators against plain versions.
PLAIN: dict[str, str] = {}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)

    def plain(v):
        return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v

    return sorted((repr([plain(v) for v in r]) for r in zip(*(table.column(n).to_pylist() for n in names)))), names


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, D)
    if name not in registry.ORACLE:
        assert name in PLAIN, f"{name} has neither SQL nor a plain version in a test"
        assert got.limit(1).count() == 1
        return
    ours, names = rows(got.toArrow())
    theirs, other = rows(duck.execute(registry.ORACLE[name]).to_arrow_table())
    assert names == other
    assert [r.replace("+00:00", "") for r in ours] == theirs
