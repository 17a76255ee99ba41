"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    if name not in entry.oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert compare(got, want) == ""


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
