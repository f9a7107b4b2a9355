"""Every registered query beside its SQL, on the same tables."""

import math

import duckdb
import pytest

from quirefold.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert got or name == "high_overlap_pairs"
    if name in plans.SQL:
        found = duck.execute(plans.SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
