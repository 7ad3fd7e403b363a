"""Every query against its SQL, over the smallest tables."""

import pytest
from conftest import SMALL, compare

from sparksift import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_sql(spark, duck, name):
    compare(core.QUERIES[name](spark, SMALL), duck.sql(core.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "offset", "length", "confidence", "level"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
