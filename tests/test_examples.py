"""Runs on built-in rows against the SQL or the rows written down for them."""

import duckdb
import pytest

from lorekeep.plans import registry

from test_registry import SF, plain


@pytest.mark.parametrize("name", sorted(registry.EXAMPLES))
def test_matches_what_is_expected(spark, name):
    got = registry.EXAMPLES[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    rel = duckdb.connect().sql(registry.EXAMPLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
