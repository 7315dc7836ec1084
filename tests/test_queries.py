"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import papyrion.queries  # noqa: F401
from papyrion import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(repr([clean(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    out = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 60
