"""Every registered query against its SQL."""

from collections import Counter

import pytest

from gridtally.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    rows, columns = [tuple(r) for r in frame.collect()], frame.columns
    found = duck.sql(ORACLES[name])
    assert sorted(columns) == sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert Counter(map(repr, rows)) == Counter(map(repr, expected))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
