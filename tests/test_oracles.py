"""Each query gives the rows of its SQL, on the smallest tables; ``check_oracles.py`` does the same at any scale."""
import pytest

from check_oracles import compare, connect
from evcat.plans.queries import QUERIES, SQL

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir).startswith(("ok", "rows only"))


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90
