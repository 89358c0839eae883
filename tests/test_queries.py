"""Every registered query runs over whole tables; those with a SQL twin give the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.conftest import SMALL

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    if name in SQL:
        assert differences(df, duck, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"message_id", "n_to", "n_cc", "n_bcc", "n_reply_to", "n_total"}


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())
