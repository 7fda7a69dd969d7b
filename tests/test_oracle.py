"""Every query against its SQL, on the smallest tables."""

import pytest
from helpers import rows_of, rows_of_sql

from linkloom.plans.oracle import ORACLE
from linkloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    assert rows_of(df) == rows_of_sql(duck, ORACLE[name], sorted(df.columns))


def test_all_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["s1_id", "cand_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
