"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

from quittance.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rounded(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = oracle.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})")
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want.fetchall())
