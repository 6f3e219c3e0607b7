import oracle
import pytest

from millrace.plans import catalogue


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, tiny, con, name):
    columns, got = oracle.spark_rows(catalogue.queries()[name](spark, tiny))
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    names, want = oracle.sql_rows(con, sql)
    assert columns == names
    assert got == want


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
