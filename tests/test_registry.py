"""Every registered query of the library against its SQL twin on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from lorekeep.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    rel = duck.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
