"""Every registered query against its SQL on the smallest tables."""

import pytest
from harness import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables are compared on the next ones; no comparison may be of nothing.
LARGER, SPARSE = "/root/testdata/sf0.01", {"unmatched_names", "catalogue_query", "heading_of_match", "context_lines"}
QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_equals_sql(spark, con, name):
    sf = LARGER if name in SPARSE else SF
    assert compare(spark, connect(sf) if name in SPARSE else con, sf, QUERIES[name], SQLS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
