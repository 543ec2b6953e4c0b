"""The queries over our own pages against their stated rows."""

import duckdb
import pytest

from sitelode.plans import golden


@pytest.mark.parametrize("name", sorted(golden.QUERIES))
def test_stated_rows(spark, name):
    got = golden.QUERIES[name](spark, "")
    found = duckdb.execute(golden.SQL[name])
    columns = [c[0] for c in found.description]
    assert got.columns == columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, found.fetchall()))
