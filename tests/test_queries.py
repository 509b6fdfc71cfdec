import pytest

from cellforge import queries as Q
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(Q.queries()[name](spark, SF), connect(SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
