from __future__ import annotations

import pytest

from brindle.queries import ORACLE, QUERIES, flagship
from tests.compare import duck, spark_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLE:
        assert (columns, rows) == duck(ORACLE[name], sf)
    else:
        assert columns and rows is not None


def test_entry_module(spark, sf):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert flagship(spark, sf).count() == 10
    assert entry.entry(spark).count() > 0
